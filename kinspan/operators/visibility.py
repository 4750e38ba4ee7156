"""Lineage joins: what rests on what, and who may see it. Never cache these across decisions; they are computed on read.

Records may carry told, all utterances (id, text, access, sensitivity) of their case that they can cite, as often as the case
has them. References are then looked up there, and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.schema import ACCESS, access_visible, filled, rank


def telling(ref: Column) -> Column:
    """The utterances of told that ref names."""
    return F.filter("told", lambda u: u["id"] == ref)


def citations(records: DataFrame, key: str = "id", *more: str) -> DataFrame:
    """(case_id, key, pos, ref_id, more): citations of utterances, in order."""
    more = [*more, *(c for c in ("told",) if c in records.columns)]
    s = records.select("case_id", key, F.posexplode("sources").alias("pos", "s"), *more)
    return s.where(F.col("s.kind") == "utterance").select("case_id", key, "pos", F.col("s.ref_id").alias("ref_id"), F.col("s.locator").alias("locator"), *more)


def cited(refs: DataFrame, utterances: DataFrame) -> DataFrame:
    """Citations with their utterance; missing is true where there is none."""
    if "told" in refs.columns:
        found = refs.withColumn("_u", F.explode_outer(telling(F.col("ref_id")))).drop("told")
        return found.select("*", "_u.text", "_u.access", "_u.sensitivity", F.col("_u.id").isNull().alias("missing")).drop("_u")
    u = utterances.select("case_id", F.col("id").alias("ref_id"), "text", "access", "sensitivity", F.lit(True).alias("_there"))
    return refs.join(u, ["case_id", "ref_id"], "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def visible_keys(refs: DataFrame, key: str, ok: Column) -> DataFrame:
    """Keys all of whose citations satisfy ok; a key without citations isn't among them. One partial aggregate, one shuffle."""
    return refs.groupBy("case_id", key).agg(F.every(F.coalesce(ok, F.lit(False))).alias("ok"), F.count("*").alias("n")).where("ok").select("case_id", key)


def utterance_ok(audience: str) -> Column:
    return ~F.col("missing") & (F.col("sensitivity") != "restricted") & access_visible(F.col("access"), audience)


def visible_to(records: DataFrame, utterances: DataFrame, audience: str, key: str = "id") -> DataFrame:
    """Records that an audience may see: every utterance cited is there, unrestricted and released. The operator sees all."""
    if audience == "operator":
        return records
    if "told" in records.columns:
        cites = F.filter("sources", lambda s: s["kind"] == "utterance")
        ok = lambda u: F.coalesce((u["sensitivity"] != "restricted") & access_visible(u["access"], audience), F.lit(False))
        return records.where((F.coalesce(F.size(cites), F.lit(0)) > 0) & F.forall(cites, lambda s: (F.size(telling(s["ref_id"])) > 0) & F.forall(telling(s["ref_id"]), ok)))
    keys = visible_keys(cited(citations(records, key), utterances), key, utterance_ok(audience))
    return records.join(keys, ["case_id", key], "left_semi")


def dangling(records: DataFrame, utterances: DataFrame, key: str = "id") -> DataFrame:
    if "told" in records.columns:
        return citations(records, key).where(F.size(telling(F.col("ref_id"))) == 0).drop("told")
    return citations(records, key).join(utterances.select("case_id", F.col("id").alias("ref_id")), ["case_id", "ref_id"], "left_anti")


def split_citations(cites: DataFrame, window: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, fabricated) citations: those of utterances in the window, and all others."""
    ids = window.select("case_id", F.col("id").alias("ref_id"))
    return cites.join(ids, ["case_id", "ref_id"], "left_semi"), cites.join(ids, ["case_id", "ref_id"], "left_anti")


def needs_owner_release(cards: DataFrame, utterances: DataFrame) -> DataFrame:
    """Cards that only the owner can release: restricted, or resting on a restricted utterance."""
    private = utterances.where("sensitivity = 'restricted'").select("case_id", F.col("id").alias("ref_id"))
    keys = citations(cards).join(private, ["case_id", "ref_id"], "left_semi").select("case_id", "id").distinct().withColumn("_private", F.lit(True))
    return cards.join(keys, ["case_id", "id"], "left").where((F.col("sensitivity") == "restricted") | F.col("_private")).drop("_private")


def siblings(cards: DataFrame, withdrawn: DataFrame, key: str = "id") -> DataFrame:
    """(case_id, withdrawn_id, id): other released cards built on an utterance that a withdrawn card rests on."""
    w = citations(withdrawn, key).select("case_id", "ref_id", F.col(key).alias("withdrawn_id"))
    out = citations(cards.where(rank(F.col("access"), ACCESS) >= 2), key).join(w, ["case_id", "ref_id"])
    return out.where(F.col(key) != F.col("withdrawn_id")).select("case_id", "withdrawn_id", key).distinct()


def release(cards: DataFrame, utterances: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, utterances, refused) after requests (case_id, id, level, note, force).

    A card and the words it rests on move together. Without force, cards that only the owner can release are refused; with
    it, restricted cards and words become tender. Of several requests for a card the last counts, by ord if they have it,
    else the one for the widest level. Words of several cards go by the last of the cards' requests in this order, then by card id.
    """
    at_order = F.col("ord") if "ord" in requests.columns else rank(F.col("level"), ACCESS)
    rest = [c for c in requests.columns if c not in ("case_id", "id")]
    requests = requests.groupBy("case_id", "id").agg(F.max_by(F.struct(*rest, at_order.alias("_order")), F.struct(at_order, "level", "note")).alias("_x")).select("case_id", "id", "_x.*")
    blocked = needs_owner_release(cards, utterances).select("case_id", "id")
    refused = requests.where(~F.coalesce("force", F.lit(False))).join(blocked, ["case_id", "id"], "left_semi").drop("_order")
    done = requests.join(refused.select("case_id", "id"), ["case_id", "id"], "left_anti").select("case_id", "id", F.col("level"), F.col("note").alias("_note"), F.coalesce("force", F.lit(False)).alias("_force"), "_order")
    new_cards = _released(cards.join(done, ["case_id", "id"], "left"), at, F.lit(True)).select(*cards.columns)
    words = citations(cards).join(done, ["case_id", "id"]).groupBy("case_id", F.col("ref_id").alias("_ref"))
    last = F.max_by(F.struct("level", "_note"), F.struct("_order", "id")).alias("_x")
    words = words.agg(last, F.bool_or("_force").alias("_force")).select("case_id", F.col("_ref").alias("id"), "_x.*", "_force")
    new_words = _released(utterances.join(words, ["case_id", "id"], "left"), at, F.col("_force")).select(*utterances.columns)
    return new_cards, new_words, refused


def _released(df: DataFrame, at: Column, soften: Column) -> DataFrame:
    hit = F.col("level").isNotNull()
    return df.withColumns(
        {
            "access": F.when(hit, F.col("level")).otherwise(F.col("access")),
            "sensitivity": F.when(hit & soften & (F.col("sensitivity") == "restricted"), "tender").otherwise(F.col("sensitivity")),
            "released_at": F.when(hit, at).otherwise(F.col("released_at")),
            "released_note": F.when(hit, F.col("_note")).otherwise(F.col("released_note")),
        }
    )


def restrict(cards: DataFrame, utterances: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, utterances, siblings) after cards (case_id, id, note) are pulled back to the owner with their words."""
    req = requests.groupBy("case_id", "id").agg(F.coalesce(F.max("note"), F.lit("kept private")).alias("_note"))
    withdrawn = cards.join(req.select("case_id", "id"), ["case_id", "id"], "left_semi")
    words = citations(withdrawn).join(req, ["case_id", "id"]).groupBy("case_id", F.col("ref_id").alias("_ref")).agg(F.max("_note").alias("_note")).withColumnRenamed("_ref", "id")

    def pulled(df: DataFrame, by: DataFrame) -> DataFrame:
        hit = F.col("_note").isNotNull()
        j = df.join(by, ["case_id", "id"], "left")
        return j.withColumns(
            {
                "access": F.when(hit, "owner_only").otherwise(F.col("access")),
                "sensitivity": F.when(hit, "restricted").otherwise(F.col("sensitivity")),
                "released_at": F.when(~hit, F.col("released_at")),
                "released_note": F.when(hit, F.col("_note")).otherwise(F.col("released_note")),
            }
        ).select(*df.columns)

    return pulled(cards, req), pulled(utterances, words), siblings(cards, withdrawn)


def usable_cards(cards: DataFrame) -> DataFrame:
    """Released to the family or wider and not restricted."""
    return cards.where((rank(F.col("access"), ACCESS) >= 2) & (F.col("sensitivity") != "restricted"))


def is_scene() -> Column:
    return filled(F.col("conflict")) & filled(F.col("consequence")) & (F.col("strength") >= 3)


def missing_beats() -> Column:
    """Names of the narrative parts that a card lacks."""
    beats = ("setup", "conflict", "choice", "consequence", "reflection")
    return F.filter(F.array(*[F.when(~filled(F.col(b)), F.lit(b)) for b in beats]), lambda x: x.isNotNull())


def short_source(source: Column) -> Column:
    return F.concat_ws("@", source["ref_id"], F.nullif(source["locator"], F.lit("")))


def all_names() -> Column:
    return F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))


def names_in_order(records: DataFrame, ids: str, names: DataFrame, out: str) -> DataFrame:
    """(case_id, id, out): the names of an id list, in list order, ids that have none left out."""
    x = records.select("case_id", "id", F.posexplode(ids).alias("pos", "_ref")).join(names.select("case_id", F.col("id").alias("_ref"), "name"), ["case_id", "_ref"])
    return x.groupBy("case_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias(out))


def unextracted_sessions(sessions: DataFrame, utterances: DataFrame, cites: DataFrame) -> DataFrame:
    """Sessions not extracted yet, without old ones that have no plan but a cited utterance. cites: (case_id, ref_id)."""
    used = utterances.join(cites.select("case_id", F.col("ref_id").alias("id")), ["case_id", "id"], "left_semi").select("case_id", "session_id").distinct()
    used = used.select("case_id", F.col("session_id").alias("id"), F.lit(True).alias("_used"))
    open_ = sessions.where(F.col("extracted_at").isNull()).join(used, ["case_id", "id"], "left")
    return open_.where(filled(F.col("extract_plan")) | F.col("_used").isNull()).drop("_used").orderBy("case_id", "number")
