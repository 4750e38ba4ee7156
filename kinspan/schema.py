"""Tables of an archive and the fixed orders of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations in their order.
ACCESS = ("owner_only", "operator", "family", "public")
SENSITIVITY = ("routine", "tender", "contested", "restricted")
ROLES = ("owner", "interviewer", "family", "unknown")
SOURCE_KINDS = ("utterance", "artifact", "family_note", "document")
CLAIM_STATUS = ("stated_by_owner", "confirmed_by_family", "documentary", "conflicting", "unresolved", "excluded")
CLAIM_KINDS = ("name", "date", "relationship", "place", "photo_subject", "event", "other")
CONFIRMABLE = CLAIM_KINDS[:5]
OPEN_STATUS = ("stated_by_owner", "unresolved", "conflicting")
CONSENT_SCOPES = ("recording", "ai_processing", "family_sharing", "print", "public_release", "third_party_services", "model_training")
OUTCOMES = ("scene", "detail", "summary", "declined", "no_memory", "untagged")
STAGES = ("setup", "interview", "transcript_cleanup", "story_cards", "photo_handling", "confirmation_chasing", "narrative_direction", "drafting", "editorial_review", "design_and_print", "delivery")
SEVERITY = ("block", "warn", "info")
TARGET_HOURS = {"A": 8, "B": 20, "C": 100}

SOURCE = "struct<kind:string,ref_id:string,locator:string,note:string>"
SOURCES = f"array<{SOURCE}>"
IDS = "array<string>"
RELEASE = "access string, sensitivity string, released_at timestamp, released_note string"

#: Collections of a case; every table also has case_id, and ord for the order in which its rows were added.
COLLECTIONS = {
    "sessions": "id string, number int, held_on date, mode string, duration int, interviewer string, source_file string, note string, extracted_at timestamp, extract_plan string, extract_windows_done int",
    "utterances": f"id string, session_id string, seq int, speaker string, role string, t_start string, text string, {RELEASE}",
    "people": f"id string, name string, aliases {IDS}, relationship string, birth_year int, death_year int, notes string, access string, sensitivity string, sources {SOURCES}",
    "places": f"id string, name string, names_over_time {IDS}, region string, notes string, sources {SOURCES}",
    "life_events": f"id string, summary string, year int, year_end int, approximate boolean, place_id string, participant_ids {IDS}, significance string, access string, sensitivity string, sources {SOURCES}",
    "quotes": f"id string, text string, speaker_person_id string, source {SOURCE}, access string, publication_ok boolean",
    "artifacts": f"id string, kind string, path string, caption string, year int, depicts {IDS}, contributed_by string, original_path string, derived_from_id string, transformation string, pixel_width int, pixel_height int",
    "claims": f"id string, text string, kind string, status string, subject_id string, sources {SOURCES}, conflicting_with {IDS}, confirmed_by string, confirmed_at timestamp, importance int, access string, notes string",
    "story_cards": f"id string, title string, period string, year int, year_end int, approximate boolean, setup string, conflict string, choice string, consequence string, reflection string, person_ids {IDS}, place_ids {IDS}, quote_ids {IDS}, claim_ids {IDS}, theme_ids {IDS}, artifact_ids {IDS}, sources {SOURCES}, strength int, notes string, operator_note string, {RELEASE}",
    "themes": f"id string, name string, description string, story_card_ids {IDS}",
    "consents": "id string, scope string, granted_by string, role string, granted boolean, granted_at timestamp, expires_at timestamp, capacity_assessed_by string",
    "questions": f"id string, session_id string, text string, bank_id string, topic string, asked_at timestamp, outcome string, produced_ids {IDS}, birth_decade int, mode string",
    "labour": "stage string, minutes int, at timestamp, who string, note string",
}
META = f"id string, owner_name string, owner_preferred_name string, sponsor_name string, reviewer_name string, operator_name string, owner_birth_year int, language string, dialect string, mode string, package string, trigger string, private_topics {IDS}, inheritor string, created_at timestamp, notes string"
FINDING = "check string, severity string, message string, ref_id string, detail string"


def archive_type() -> T.StructType:
    """The schema of one archive document: meta, a list per collection, revision and time of change."""
    lists = ", ".join(f"{name}: array<struct<{_colons(fields)}>>" for name, fields in COLLECTIONS.items())
    return T.StructType.fromDDL(f"meta struct<{_colons(META)}>, revision long, updated_at timestamp, {lists.replace(': array', ' array')}")


def _colons(fields: str) -> str:
    """`a int, b string` as the inside of a struct type."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(fields).fields)


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Position in an enumeration; null for other values."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), column)
    return F.when(at > 0, (at - 1).cast("int"))


def access_visible(access: Column, audience: str) -> Column:
    """The operator sees all; others see what is released to them or more widely."""
    return F.lit(True) if audience == "operator" else F.coalesce(rank(access, ACCESS) >= ACCESS.index(audience), F.lit(False))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def year(column: Column) -> Column:
    """A year, where 0 is no year."""
    return F.nullif(column, F.lit(0))
