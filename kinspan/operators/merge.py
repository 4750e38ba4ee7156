"""Extraction results into records of a case: mentions are gathered with their places and grouped by what makes them one.

A place is (window, stage, part, pos): records that are there already come first, then windows in order. What is first,
longest or highest of a record follows from the places of its mentions, so nothing is looked up while results come in. Only
which moment a card tells depends on the cards before it. A case is one task: interviews with one person, which bounds it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions.fuzzy import FIDELITY, partial
from kinspan.functions.text import clean, key_of, name_the_owner, strip
from kinspan.providers import RESULT
from kinspan.sources.stage import kept

# Fixed value: share of common sources from which two cards tell the same moment.
SAME_SCENE = 0.5
BEATS = ("conflict", "choice", "consequence", "reflection")

OUT = "case_id string, collection string, id string, ord int, record string"
LISTS = ("dropped_citations", "unquotable", "notes", "followups")
_BEFORE = -1  # the window of records that are there already


def plain(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (text or "").lower())).strip()


def squashed(text: str | None) -> str:
    return plain(text).replace(" ", "")


def title_key(text: str | None) -> str:
    return re.sub(r"[\W_]", "", (text or "").lower())


def name_key(name: str) -> str:
    return name.strip().lower()


# ---- mentions and groups ------------------------------------------------------------------------------------------


def distinct(lists: Iterable) -> list:
    return list(dict.fromkeys(x for one in lists for x in one or ()))


def first_filled(mentions: list[dict], field: str):
    return next((m[field] for m in mentions if m.get(field)), None)


def grouped(mentions: list[dict], key: Callable[[dict], object]) -> list[list[dict]]:
    """Mentions by key, each group in order of place, groups by their first place. A record that is there heads a group of
    its own, though another has its key; mentions go to the first group with their key."""
    groups: list[list[dict]] = []
    of: dict = {}
    for m in sorted(mentions, key=lambda m: m["place"]):
        k = key(m)
        if m["place"][0] == _BEFORE or k not in of:
            groups.append([m])
            of.setdefault(k, groups[-1])
        else:
            of[k].append(m)
    return groups


def moments(cards: list[dict]) -> list[list[dict]]:
    """Cards in order of place by the moment they tell.

    A card joins the earliest moment that shares SAME_SCENE of all their sources with it, or one source and the title. A
    moment has the sources of all its cards and the title of its strongest. Moments are looked up by source.
    """
    out: list[list[dict]] = []
    known: list[tuple[set[str], str, int]] = []
    holds: dict[str, set[int]] = {}
    for c in sorted(cards, key=lambda c: c["place"]):
        mine, title = set(c["sources"]), title_key(c["title"])
        met = {n for r in mine for n in holds.get(r, ())} if c["place"][0] != _BEFORE else ()
        n = next((n for n in sorted(met) if len(mine & known[n][0]) >= SAME_SCENE * len(mine | known[n][0]) or (title and title == known[n][1])), len(out))
        if n == len(out):
            out.append([])
            known.append((set(), title, c["strength"]))
        sources, name, best = known[n]
        known[n] = (sources | mine, title if c["strength"] > best else name, max(best, c["strength"]))
        for r in mine:
            holds.setdefault(r, set()).add(n)
        out[n].append(c)
    return out


def moments_by_joins(cards: DataFrame) -> DataFrame:
    """Adds moment, the ord of the first card of the moment that a card tells, by the rule of moments().

    cards: case_id, ord (distinct in a case), title, strength, sources (ids); existing, if there, marks records that head a
    moment of their own. The rule goes from card to card, as a moment's sources and title are those of its cards so far. Here
    all cards choose at once, by joins on sources, from the moments as they were chosen in the round before, of which a card
    sees what came before it; a card is settled once those before it are, so when nothing changes any more all have chosen as
    one after the other would. That takes as many rounds as choices hang on one another, not as there are cards, and a case
    may be any number of tasks.
    """
    existing = F.coalesce("existing", F.lit(False)) if "existing" in cards.columns else F.lit(False)
    c = kept(
        cards.select(
            "case_id", F.col("ord").cast("long").alias("ord"), key_of(F.coalesce("title", F.lit(""))).alias("_key"), F.coalesce("strength", F.lit(0)).cast("int").alias("_strength"),
            F.coalesce(F.array_distinct(F.array_compact("sources")), F.array().cast("array<string>")).alias("_sources"), existing.alias("_existing"),
        )
    )
    cites = c.select("case_id", "ord", "_existing", F.size("_sources").alias("_own"), "_key", F.explode("_sources").alias("source"))
    chosen = c.select("case_id", "ord", F.col("ord").alias("moment"))
    before = Window.partitionBy("case_id", "moment").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    while True:
        has = cites.select("case_id", "ord", "source").join(chosen, ["case_id", "ord"]).groupBy("case_id", "moment", "source").agg(F.min("ord").alias("at"))
        met = cites.where("not _existing").join(has, ["case_id", "source"]).where("at < ord").groupBy("case_id", "moment", "ord", "_own", "_key").agg(F.count("*").alias("_common"))
        told = c.join(chosen, ["case_id", "ord"]).select("case_id", "moment", F.col("ord").alias("at"), F.struct("_strength", (-F.col("ord")).alias("_first"), "_key").alias("_head"))
        seen = has.select("case_id", "moment", "at", F.lit(1).alias("_n")).unionByName(told, True).unionByName(met.withColumn("at", F.col("ord")), True)
        seen = seen.withColumns({"_size": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_title": F.max("_head").over(before)["_key"]}).where("_common is not null")
        same = F.col("_common") >= SAME_SCENE * (F.col("_own") + F.col("_size") - F.col("_common"))
        found = seen.where(same | ((F.col("_key") != "") & (F.col("_key") == F.col("_title")))).groupBy("case_id", "ord").agg(F.min("moment").alias("moment"))
        after = kept(c.select("case_id", "ord").join(found, ["case_id", "ord"], "left").select("case_id", "ord", F.coalesce("moment", "ord").alias("moment")))
        settled = after.join(chosen, ["case_id", "ord", "moment"], "left_anti").isEmpty()
        chosen = after
        if settled:
            return cards.join(chosen.withColumn("ord", F.col("ord").cast(cards.schema["ord"].dataType)), ["case_id", "ord"])


class Case:
    """Mentions of one case, and the records that they make."""

    def __init__(self, case_id: str, known: dict[str, list[dict]]):
        self.case_id = case_id
        self.mentions = {name: [{**r, "place": (_BEFORE, 0, 0, i)} for i, r in enumerate(known.get(name, ()))] for name in ("people", "places", "claims", "quotes", "story_cards")}
        self.entries: list[tuple[tuple, str, str]] = []

    def id(self, prefix: str, *key) -> str:
        """Ids follow from content, so a rerun gives the same ones."""
        return f"{prefix}_{hashlib.sha256(json.dumps([self.case_id, *key]).encode()).hexdigest()[:10]}"

    def cited(self, ids: list[str] | None, words: dict, place: tuple) -> list[str]:
        self.entries += [((*place, i), "dropped_citations", x) for i, x in enumerate(ids or ()) if x not in words]
        return [x for x in ids or () if x in words]

    def gather(self, window: int, result: dict, words: dict[str, dict]) -> None:
        """The mentions of one result, which may cite the words of its own window alone."""
        for stage, name, more in ((0, "people", "relationship"), (1, "places", "region")):
            for i, x in enumerate(result.get(name) or ()):
                place = (window, stage, i, 0)
                self.mentions[name].append({"place": place, "name": x["name"], more: x.get(more), "sources": self.cited(x.get("source_utterance_ids"), words, place)})
        for i, x in enumerate(result.get("claims") or ()):
            place = (window, 2, i, 0)
            refs = self.cited(x.get("source_utterance_ids"), words, place)
            if refs:
                self.mentions["claims"].append({"place": place, "text": x["text"], "kind": x["kind"], "status": "stated_by_owner", "importance": x.get("importance") or 3, "sources": refs})
        for i, x in enumerate(result.get("story_cards") or ()):
            place = (window, 3, i, 0)
            refs = self.cited(x.get("source_utterance_ids"), words, place)
            if not refs:
                self.entries.append((place, "notes", f"dropped story card '{x['title']}': no valid citations"))
                continue
            said = [q for j, q in enumerate(x.get("quotes") or ()) if self.borne_out(q, words, (window, 3, i, 1 + j))]
            self.mentions["quotes"] += [{"place": (window, 3, i, 1 + j), "card": place, "text": q["text"].strip(), "source": q["source_utterance_id"], "locator": words[q["source_utterance_id"]].get("t_start")} for j, q in enumerate(said)]
            self.mentions["story_cards"].append({**x, "place": place, "sources": distinct([refs]), "strength": x.get("strength") or 0})
        if result.get("notes"):
            self.entries.append(((window, 4, 0, 0), "notes", result["notes"]))

    def borne_out(self, quote: dict, words: dict, place: tuple) -> bool:
        """Whether the utterance cited has the words of a quote; others are only reported."""
        if not self.cited([quote["source_utterance_id"]], words, place):
            return False
        needle = squashed(quote["text"])
        fits = bool(needle) and partial(needle, squashed(words[quote["source_utterance_id"]]["text"])) >= FIDELITY
        if not fits:
            self.entries.append((place, "unquotable", quote["text"][:60]))
        return fits

    def records(self) -> dict[str, list[dict]]:
        out, added, again = {}, {}, 0
        claims = grouped(self.mentions["claims"], lambda m: (m["kind"], plain(m["text"])))
        out["claims"] = [
            {"id": g[0].get("id") or self.id("clm", g[0]["kind"], plain(g[0]["text"])), **{f: g[0].get(f) for f in ("text", "kind", "status")}, "importance": max(m["importance"] for m in g), "sources": distinct(m["sources"] for m in g)} for g in claims
        ]
        quotes = grouped(self.mentions["quotes"], lambda m: (m["source"], plain(m["text"])))
        out["quotes"] = [{"id": g[0].get("id") or self.id("quo", g[0]["source"], plain(g[0]["text"])), **{f: g[0].get(f) for f in ("text", "source", "locator")}} for g in quotes]
        quoted: dict[tuple, list] = {}
        for place, card, key in sorted((m["place"], m["card"], r["id"]) for g, r in zip(quotes, out["quotes"], strict=True) for m in g if "card" in m):
            quoted.setdefault(card, []).append(key)
        # a claim of the card's window counts for it if a source of the claim, as known by then, is the card's
        told: dict[int, list] = {}
        for place, n in sorted((m["place"], n) for n, g in enumerate(claims) for m in g if m["place"][0] != _BEFORE):
            told.setdefault(place[0], []).append(n)
        linked = lambda c: [out["claims"][n]["id"] for n in told.get(c["place"][0], ()) if any(set(m["sources"]) & set(c["sources"]) for m in claims[n] if m["place"][0] <= c["place"][0])]
        for c in self.mentions["story_cards"]:
            if c["place"][0] != _BEFORE:
                c |= {"quote_ids": quoted.get(c["place"], []), "claim_ids": linked(c)}
        scenes = moments(self.mentions["story_cards"])
        for g in scenes:
            if g[0]["place"][0] != _BEFORE:  # names in a card count where it is a record of its own
                for name in ("people", "places"):
                    self.mentions[name] += [{"place": (*g[0]["place"][:3], i), "name": n, "sources": [], "card": g[0]["place"]} for i, n in enumerate(g[0].get(name) or ())]
        ids = {}
        for name, prefix, more in (("people", "per", "relationship"), ("places", "plc", "region")):
            groups, out[name], ids[name] = *self.named(self.mentions[name], prefix, more), {}
            for g, r in zip(groups, out[name], strict=True):
                for m in g:
                    if "card" in m:
                        ids[name].setdefault(m["card"], []).append((m["place"], r["id"]))
            added[name] = sum(g[0]["place"][0] != _BEFORE for g in groups)
        out["story_cards"] = [self.scene(g, ids) for g in scenes]
        self.entries += [(g[0]["place"], "followups", g[0]["followup_question"]) for g in scenes if g[0]["place"][0] != _BEFORE and g[0].get("followup_question")]
        for name, groups in (("claims", claims), ("quotes", quotes), ("story_cards", scenes)):
            added[name] = sum(g[0]["place"][0] != _BEFORE for g in groups)
            again += 0 if name == "quotes" else sum(len(g) - 1 for g in groups)
        listed = {what: [x for _, w, x in sorted(self.entries) if w == what] for what in LISTS}
        out["report"] = [{"id": "report", **{f"{name}_added": n for name, n in added.items()}, "duplicates_merged": again, **listed}]
        private = {r for c in self.mentions["story_cards"] if c["place"][0] != _BEFORE and c.get("sensitivity") == "restricted" for r in c["sources"]}
        out["restricted"] = [{"id": r} for r in sorted(private)]
        return out

    def named(self, mentions: list[dict], prefix: str, more: str) -> tuple[list[list[dict]], list[dict]]:
        """Names equal but for case and outer space, or an alias of a record that is there, are one; sources are appended."""
        alias = {}
        for m in sorted(mentions, key=lambda m: m["place"]):
            for n in (m["name"], *(m.get("aliases") or ())):
                alias.setdefault(name_key(n), name_key(m["name"]))
        groups = grouped(mentions, lambda m: alias[name_key(m["name"])])
        return groups, [
            {**{k: v for k, v in g[0].items() if k not in ("place", "card")}, "id": g[0].get("id") or self.id(prefix, name_key(g[0]["name"])), "name": g[0]["name"].strip(), more: first_filled(g, more), "sources": [r for m in g for r in m["sources"] or ()]} for g in groups
        ]

    def scene(self, g: list[dict], ids: dict) -> dict:
        """The record of a moment: the strongest card's title, the first of each beat, the longest setup, all sources."""
        head, dated = g[0], next((c for c in g if c.get("year") is not None), g[0])
        new = head["place"][0] != _BEFORE
        names = lambda name, field: [i for _, i in sorted(ids[name].get(head["place"], ()))] if new else head.get(field) or []
        strongest = max(g, key=lambda c: c["strength"])
        return {
            "id": self.id("card", head["title"], head["sources"]) if new else head["id"], "title": strongest["title"], "strength": strongest["strength"], "period": head.get("period"),
            "year": dated.get("year"), "year_end": dated.get("year_end"), "approximate": dated.get("approximate") or False, "setup": max((c.get("setup") or "" for c in g), key=len),
            **{b: first_filled(g, b) for b in BEATS}, "person_ids": names("people", "person_ids"), "place_ids": names("places", "place_ids"),
            **{f: distinct(c.get(f) for c in g) for f in ("sources", "quote_ids", "claim_ids")}, "access": "operator" if new else head.get("access"),
            "sensitivity": "restricted" if any(c.get("sensitivity") == "restricted" for c in g) else head.get("sensitivity") or "routine", "operator_note": head.get("followup_question") if new else head.get("operator_note"),
        }


def merge_results(results: DataFrame, utterances: DataFrame, windows: DataFrame, owners: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Results (case_id, window, result JSON) over windows (case_id, window, id) as records (see OUT), with a report per case.

    Only a window's own utterances can be cited. owners (case_id, name): names put in for "the story owner" and the like in
    claims and cards before anything is compared. existing: records (see OUT) that are there already and come first; results
    that tell of them again add to them, and they are part of the result. A result that doesn't fit its schema is an error.
    """
    words = windows.join(utterances.select("case_id", "id", "text", "t_start"), ["case_id", "id"])
    words = words.groupBy("case_id", "window").agg(F.to_json(F.collect_list(F.struct("id", "text", "t_start"))).alias("words"))
    rows = results.select("case_id", "window", F.from_json("result", RESULT, {"mode": "FAILFAST"}).alias("r"))
    if owners is not None:
        rows = rows.join(owners.select("case_id", F.col("name").alias("_owner")), "case_id", "left")
        put = lambda c: name_the_owner(c, F.col("_owner"))
        kind = rows.schema["r"].dataType
        named = {f: F.transform(f"r.{f}", _put(kind[f].dataType.elementType.names, put)) for f in ("claims", "story_cards")}
        rows = rows.withColumn("r", F.struct(*[named.get(f, F.col(f"r.{f}")).alias(f) for f in kind.names]))
    rows = rows.join(words, ["case_id", "window"], "left").select("case_id", F.col("window").cast("int").alias("window"), F.to_json("r").alias("result"), "words", F.lit(None).cast("string").alias("collection"))
    if existing is not None:
        rows = rows.unionByName(existing.select("case_id", F.col("ord").alias("window"), F.col("record").alias("result"), F.lit(None).cast("string").alias("words"), "collection"))

    def one(x: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, list[dict]] = {}
        for r in x[x["collection"].notna()].sort_values("window").itertuples(index=False):
            known.setdefault(r.collection, []).append(json.loads(r.result))
        state = Case(x["case_id"].iloc[0], known)
        for r in x[x["collection"].isna()].sort_values("window").itertuples(index=False):
            state.gather(r.window, json.loads(r.result), {w["id"]: w for w in json.loads(r.words or "[]")})
        out = [(state.case_id, name, r["id"], i, json.dumps(r, ensure_ascii=False, sort_keys=True)) for name, records in state.records().items() for i, r in enumerate(records)]
        return pd.DataFrame(out, columns=["case_id", "collection", "id", "ord", "record"])

    return rows.groupBy("case_id").applyInPandas(one, OUT)


def _put(fields: list[str], put: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of a record that puts the owner's name into its sentences."""
    return lambda record: F.struct(*[(put(record[f]) if f in ("text", "title", "setup", *BEATS) else record[f]).alias(f) for f in fields])


def dedupe_claims(claims: DataFrame, by: tuple = ("case_id", "kind")) -> DataFrame:
    """Claims equal in kind and cleaned text: the first one's id and text, the highest importance, all sources."""
    c = claims.withColumn("_key", clean(F.col("text")))
    return c.groupBy(*by, "_key").agg(F.min_by("id", "ord").alias("id"), F.min_by("text", "ord").alias("text"), F.max("importance").alias("importance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"), F.count("*").alias("merged")).drop("_key")


def upsert_names(mentions: DataFrame, more: str = "relationship") -> DataFrame:
    """Names equal but for case and outer space: first spelling, and the first value known of `more`."""
    m = mentions.withColumn("_key", F.lower(strip(F.col("name"))))
    return m.groupBy("case_id", "_key").agg(F.min_by("name", "ord").alias("name"), F.min_by(more, F.when(F.col(more).isNotNull(), F.col("ord"))).alias(more), F.count("*").alias("mentions")).drop("_key")
