"""Documents, chronologies, intakes, entities and changes as column rules and per-document folds."""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.core import strip, tasks_of
from docketlake.functions.scratch import Steps
from docketlake.operators.similarity import first_of_each, lowered, similar_pairs

# ------------------------------------------------------------------ fixed values
# Patterns, word lists and weights that decide classes.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
EVENT_TYPES = {
    "filing": ["filed", "filing", "complaint", "motion", "petition", "brief", "pleading", "summons", "subpoena", "appeal"],
    "hearing": ["hearing", "oral argument", "conference", "calendar call", "pretrial", "arraignment", "sentencing"],
    "incident": ["accident", "incident", "injury", "collision", "assault", "event occurred", "took place"],
    "communication": ["letter", "email", "correspondence", "notification", "notice", "sent", "received", "called", "contacted"],
    "medical": ["diagnosis", "treatment", "surgery", "examination", "medical", "hospital", "doctor", "physician", "injury report"],
    "payment": ["payment", "invoice", "bill", "paid", "settlement", "damages", "compensation", "reimbursement"],
    "deadline": ["deadline", "due date", "statute of limitations", "expiration", "must be filed by", "response due"],
    "meeting": ["meeting", "conference call", "mediation", "arbitration", "negotiation", "deposition scheduled"],
    "deposition": ["deposition", "deposed", "testimony", "sworn statement", "examination under oath"],
    "order": ["order", "ruling", "judgment", "decree", "injunction", "decision", "opinion"],
}
MATTERS = {
    "personal_injury": ["accident", "injury", "injured", "crash", "collision", "slip", "fall", "medical", "hospital", "surgery", "disability", "pain", "suffering", "negligence", "liability", "damages", "insurance claim", "malpractice", "wrongful death", "product liability", "workers comp", "workers compensation"],
    "family_law": ["divorce", "custody", "child support", "alimony", "separation", "prenuptial", "prenup", "visitation", "adoption", "guardianship", "domestic violence", "restraining order", "marriage", "spousal support", "marital", "paternity", "child protective"],
    "criminal_defense": ["arrest", "criminal", "charge", "felony", "misdemeanor", "dui", "dwi", "assault", "battery", "theft", "drug", "possession", "probation", "parole", "sentencing", "plea", "defendant", "prosecutor", "bail", "indictment", "trial", "verdict", "conviction"],
    "immigration": ["visa", "green card", "citizenship", "deportation", "asylum", "immigration", "naturalization", "uscis", "ice", "work permit", "i-130", "i-485", "h-1b", "daca", "refugee", "permanent resident", "travel document", "consulate", "embassy", "overstay"],
    "corporate": ["corporation", "llc", "partnership", "shareholder", "merger", "acquisition", "formation", "bylaws", "operating agreement", "board of directors", "securities", "compliance", "contract", "non-compete", "trademark", "intellectual property"],
    "real_estate": ["property", "deed", "mortgage", "lease", "landlord", "tenant", "eviction", "foreclosure", "title", "closing", "zoning", "real estate", "boundary", "easement", "hoa", "homeowner"],
    "employment": ["employer", "employee", "termination", "fired", "discrimination", "harassment", "wage", "overtime", "wrongful termination", "retaliation", "eeoc", "ada", "fmla", "severance", "non-disclosure", "workplace"],
    "estate_planning": ["will", "trust", "estate", "probate", "executor", "beneficiary", "power of attorney", "living will", "testament", "inheritance", "trustee", "heir", "decedent", "succession"],
    "bankruptcy": ["bankruptcy", "chapter 7", "chapter 11", "chapter 13", "debt", "creditor", "debtor", "discharge", "filing", "insolvency", "means test", "automatic stay", "trustee", "liquidation"],
    "intellectual_property": ["patent", "trademark", "copyright", "trade secret", "infringement", "ip", "licensing", "fair use", "dmca", "prior art", "registration", "intellectual property"],
}
ROLES = {
    "Client": ["client", "caller", "contacted", "wants to", "needs", "seeking"],
    "Opposing Party": ["defendant", "opposing", "against", "sued", "vs", "versus"],
    "Spouse": ["spouse", "husband", "wife", "married to", "ex-husband", "ex-wife"],
    "Attorney": ["attorney", "lawyer", "counsel", "esq", "law firm", "representing"],
    "Witness": ["witness", "testified", "saw", "observed"],
    "Employer": ["employer", "company", "works for", "employed by"],
    "Insurance": ["insurance", "insurer", "adjuster", "carrier"],
    "Judge": ["judge", "honor", "court"],
    "Doctor": ["doctor", "dr.", "physician", "medical", "treated by"],
}
LIMITATION_YEARS = {
    "personal_injury": {"default": 2, "CA": 2, "NY": 3, "TX": 2, "FL": 4, "IL": 2, "PA": 2, "OH": 2, "GA": 2, "NC": 3, "MI": 3, "NJ": 2, "VA": 2, "WA": 3, "MA": 3, "AZ": 2, "CO": 2, "MD": 3, "MN": 6, "WI": 3, "MO": 5},
    "employment": {"default": 1, "CA": 3, "NY": 3, "TX": 1, "FL": 1, "IL": 1},
    "real_estate": {"default": 4, "CA": 4, "NY": 6, "TX": 4, "FL": 5, "IL": 5},
    "corporate": {"default": 4, "CA": 4, "NY": 6, "TX": 4, "FL": 5},
    "intellectual_property": {"default": 3},
}
HIGH_RISK = [
    r"\b(?:price|pricing|cost|fee|payment|compensation|salary|wage)\b", r"\b(?:liability|liable|damages|penalty|penalties|liquidated\s+damages)\b", r"\b(?:indemnif|indemnity|hold\s+harmless)\b",
    r"\b(?:termination|terminate|cancel|cancellation)\b", r"\b(?:governing\s+law|jurisdiction|arbitration|dispute\s+resolution|venue)\b", r"\b(?:warranty|warranties|guarantee|representation)\b",
    r"\b(?:intellectual\s+property|IP\s+rights|patent|copyright|trademark)\b", r"\b(?:confidential|non-disclosure|NDA|trade\s+secret)\b", r"\b(?:limitation\s+of\s+liability|cap|aggregate|maximum)\b",
    r"\b(?:non-compete|non-solicitation|restrictive\s+covenant)\b", r"\b(?:insurance|coverage|deductible)\b", r"\b(?:assignment|transfer|subcontract)\b", r"\b(?:force\s+majeure)\b",
]
MEDIUM_RISK = [
    r"\b(?:obligation|duty|shall|must|required|responsible)\b", r"\b(?:condition|contingent|subject\s+to|provided\s+that)\b", r"\b(?:notice|notification|written\s+notice|days?\s+(?:prior|advance))\b",
    r"\b(?:renewal|extension|option|right\s+of\s+first)\b", r"\b(?:deliverable|milestone|deadline|timeline|schedule)\b", r"\b(?:scope|specification|standard|requirement)\b",
    r"\b(?:approve|approval|consent)\b", r"\b(?:exclusiv|sole|preferr)\b", r"\b(?:audit|inspection|review\s+right)\b",
]
_WHOLE = re.compile(r"\\b\(\?:(.*)\)\\b")


def _any_word(patterns: list[str]) -> str:
    """One pattern for texts in lower case that is found where one of ``patterns``, words between bounds, is: bounds are looked for once
    and not by each."""
    return rf"\b(?:{'|'.join(_WHOLE.fullmatch(p)[1].lower() for p in patterns)})\b"


RISK_RELEVANT = "(?:liability|indemnif|damages|penalty|limitation)"
SECTION = r"(?i)^(?:(?:ARTICLE|SECTION|CHAPTER|PART)\s+[\dIVXLCDM]+|(?:\d+\.)+\s+|[IVXLCDM]+\.\s+|[A-Z]\.\s+)"
BOUNDARIES = [(r"^\s*(\d+\.)+\s+\S", 90), (r"^\s*[IVXLCDM]+\.\s+\S", 85), (r"^\s*[A-Z]\.\s+\S", 80), (r"(?i)^\s*(Section|Article|Chapter|Part)\s+[\dIVXLCDM]+", 95)]
KEY_MOMENTS = {
    "admission": [r"\bi admit\b", r"\bthat'?s correct\b", r"\byes,?\s*i did\b", r"\bi acknowledge\b", r"\bi agree\b", r"\bthat is true\b", r"\bi confirm\b", r"\byou'?re right\b", r"\bthat'?s right\b", r"\bi concede\b", r"\bi accept\b"],
    "objection": [r"\bobjection\b", r"\binstruct the witness\b", r"\bmove to strike\b", r"\basked and answered\b", r"\bbeyond the scope\b", r"\bcalls for speculation\b", r"\bform of the question\b", r"\bcompound question\b", r"\bargumentative\b", r"\bassuming facts\b", r"\bvague and ambiguous\b", r"\blacks foundation\b"],
    "uncertainty": [r"\bi don'?t recall\b", r"\bi don'?t remember\b", r"\bto the best of my recollection\b", r"\bi'?m not sure\b", r"\bi can'?t recall\b", r"\bi can'?t remember\b", r"\bi have no recollection\b", r"\bi don'?t know\b", r"\bnot to my knowledge\b", r"\bi'?m not certain\b", r"\bi believe so\b", r"\bi think so\b"],
    "legal_term": [r"\bunder oath\b", r"\bsworn testimony\b", r"\bfor the record\b", r"\boff the record\b", r"\blet the record reflect\b", r"\bstipulat\w+\b", r"\bexhibit\s+\w+\b", r"\bpreviously marked\b", r"\bso stipulated\b", r"\blet me mark\b"],
    "emotional": [r"\bi need a break\b", r"\bcan we take a break\b", r"\bi'?m upset\b", r"\bthis is difficult\b", r"\bi'?d rather not\b", r"\bthat'?s personal\b", r"\bi refuse\b", r"\bi won'?t answer\b"],
    "contradiction": [r"\bbut you (just |previously )?said\b", r"\bearlier you (stated|said|testified)\b", r"\bthat contradicts\b", r"\bthat'?s inconsistent\b", r"\bisn'?t it true that\b", r"\bdidn'?t you (just )?say\b", r"\bcontrary to\b", r"\bin your (prior |previous )?(testimony|statement|deposition)\b"],
}
STOP_WORDS = [
    "the", "a", "an", "is", "was", "were", "are", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "need", "dare", "ought", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "mine", "yours", "hers",
    "ours", "theirs", "this", "that", "these", "those", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other",
    "some", "such", "no", "only", "own", "same", "than", "too", "very", "just", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "what", "which", "who", "whom", "if", "whether", "well", "okay", "yes", "no", "um", "uh", "like", "know", "right", "going", "think", "said", "say", "says", "told", "tell", "tells", "go",
    "went", "gone", "come", "came", "get", "got", "make", "made", "take", "took", "see", "saw", "give", "gave", "put", "let",
]
OFFICER_TITLES = ["Chief Executive Officer|CEO", "Chief Financial Officer|CFO", "Chief Operating Officer|COO", "Chief Technology Officer|CTO", "President", "Chairman|Chair of the Board", "Vice President|VP", "Secretary", "Treasurer", "Director", "General Counsel"]
ENTITY_LABELS = ["PERSON", "ORG", "DATE", "MONEY", "GPE", "LAW", "NORP", "FAC", "EVENT"]
HONORIFICS = r"^(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Hon\.|Judge|Attorney|Atty\.)\s+"
PHONE = r"(?:(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4})"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ADDRESS = r"(?i)\d+\s+[\w\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Circle|Cir|Place|Pl)\.?(?:\s*(?:#|Apt|Suite|Ste|Unit)\s*\w+)?(?:\s*,\s*\w+(?:\s+\w+)*\s*,\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?)?"
SSN = r"\b\d{3}[-]?\d{2}[-]?\d{4}\b"


# ------------------------------------------------------------------ chronology
def dates_in(text: Column) -> Column:
    """Array of (raw, day, at) of the dates in a text, in pattern order; ``at`` is the place (from 1) of this
    occurrence of ``raw``; years 1900 to 2100; a date that a longer match holds is left out."""
    def found(pattern: str, order: tuple[int, int, int], month_names: bool) -> Column:
        raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def day(raw: Column) -> Column:
            part = lambda k: F.regexp_extract(raw, pattern, k) if k else F.lit("1")
            month = part(order[1])
            if month_names:
                numbers = F.create_map(*[F.lit(x) for i, name in enumerate(MONS.split("|"), 1) for x in (name.lower(), str(i))])
                month = F.coalesce(F.try_element_at(numbers, F.lower(F.substring(month, 1, 3))), F.lit("0"))
            return F.try_to_date(F.concat_ws("-", part(order[0]), F.lpad(month, 2, "0"), F.lpad(part(order[2]), 2, "0")), "yyyy-MM-dd")

        # matches come in the order of the text: each is looked for behind the one before
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<raw:string,day:date,at:int>>").alias("found"))

        def place(held: Column, raw: Column) -> Column:
            at = F.call_function("locate", raw, text, held["next"])
            one = F.struct(raw.alias("raw"), day(raw).alias("day"), at.cast("int").alias("at"))
            return F.struct((at + F.length(raw)).cast("int").alias("next"), F.concat(held["found"], F.array(one)).alias("found"))

        return F.aggregate(raws, start, place, lambda held: held["found"])

    parts = [
        found(r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b", (3, 1, 2), False),
        found(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3), False),
        found(rf"(?i)\b({MONTHS}|{MONS})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", (3, 1, 2), True),
        found(rf"(?i)\b(\d{{1,2}})\s+({MONTHS}|{MONS})\.?,?\s+(\d{{4}})\b", (3, 2, 1), True),
    ]
    whole = F.concat(*parts)
    return F.filter(whole, lambda d: d["day"].isNotNull() & F.year(d["day"]).between(1900, 2100))


def sentence_around(text: Column, raw: Column, at: Column, short: int = 50, wide: int = 200) -> Column:
    """The sentence of the match at place ``at``: from the full stop before to the one after; if short, 200
    characters about it."""
    head = F.substring(text, F.lit(1), at - 1)
    tail = F.substring(text, at, F.length(text))
    start = F.length(head) - F.length(F.substring_index(head, ".", -1))
    after = F.locate(".", tail)
    end = F.when(after > 0, at + after - 1).otherwise(F.length(text))
    sentence = strip(F.substring(text, start + 1, (end - start).cast("int")))
    around = strip(F.substring(text, F.greatest(F.lit(1), at - wide), F.length(raw) + 2 * wide))
    return F.when(F.length(sentence) < short, around).otherwise(sentence)


def other_dates(found: Column, spans: Column) -> Column:
    """Of ``spans`` (at, raw), such as a model's, those that no date of ``found`` (raw, day, at) overlaps."""
    def free(s: Column) -> Column:
        return ~F.exists(found, lambda d: (s["at"] < d["at"] + F.length(d["raw"])) & (s["at"] + F.length(s["raw"]) > d["at"]))

    return F.filter(spans, free)


def best_class(text: Column, lists: dict[str, list[str]], other: str, counted: bool = False, whole: bool = False) -> tuple[Column, Column, Column] | Column:
    """(class, best score, total score) by keyword hits, or their counts; ties go to the first list. With ``whole``, one
    column (name, best, total), so that a query that needs several of them can work them out once. The
    word lists are an array literal that a lambda runs over, which keeps the generated code small; the
    lowered text and the scores are bound once, as elements of one-element arrays."""
    names = F.array(*[F.lit(k) for k in lists])
    words = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in lists.values()])

    def hits(t: Column):
        if counted:
            # most words are not in the text, which is quicker to see than to count
            return lambda a, w: a + F.when(F.contains(t, w), F.floor((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int")).otherwise(0)
        return lambda a, w: a + F.contains(t, w).cast("int")

    def verdict(s: Column) -> Column:
        best = F.array_max(s)
        name = F.when(best > 0, F.element_at(names, F.array_position(s, best).cast("int"))).otherwise(other)
        return F.struct(name.alias("name"), best.alias("best"), F.aggregate(s, F.lit(0), lambda a, x: a + x).alias("total"))

    scores = F.transform(F.array(F.lower(text)), lambda t: F.transform(words, lambda ws: F.aggregate(ws, F.lit(0), hits(t))))
    found = F.transform(scores, verdict)[0]
    return found if whole else (found["name"], found["best"], found["total"])


def event_type(text: Column) -> Column:
    return best_class(text, EVENT_TYPES, "other")[0]


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def dedup_events(events: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per day, in order of event_id, an event (event_id, day, text) is kept unless its text is like a kept one's. Equal
    texts of a day are one, that of the first event; see :func:`docketlake.operators.similarity.first_of_each`.
    Null texts count as empty; events without a day are a day of their own."""
    rows = events.select(F.col("event_id").alias("key"), "day", "text", lowered(F.col("text")).alias("t"), F.coalesce(F.col("day").cast("string"), F.lit("")).alias("grp"))
    first = rows.groupBy("grp", "t").agg(F.min(F.struct("key", "day", "text")).alias("f"))
    first = Steps(events.sparkSession).keep(first.select("grp", "t", "f.key", "f.day", "f.text"))
    kept = first_of_each(first.select("grp", "key", "t"), threshold)
    return first.join(kept, ["grp", "key"], "left_semi").select(F.col("key").alias("event_id"), "day", F.coalesce("text", F.lit("")).alias("text"))


def conflict_classes(events: DataFrame) -> DataFrame:
    """(event_id, class): events of one text and day are one class, named by its first event."""
    first = events.groupBy("text", "day").agg(F.min("event_id").alias("class"))
    same = F.col("text").eqNullSafe(F.col("_t")) & F.col("day").eqNullSafe(F.col("_d"))
    return events.select("event_id", F.col("text").alias("_t"), F.col("day").alias("_d")).join(first, same).select("event_id", "class")


def conflicts(events: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs of like classes (first, second) of events (event_id, doc_id, day, text): classes of different days,
    two events of which stand in different documents. Events belong to classes as of :func:`conflict_classes`,
    so that a statement made a thousand times over makes no million pairs.

    Texts are made distinct and joined by their similarity (see :func:`docketlake.operators.similarity.similar_pairs`,
    which loses none); equal texts are alike without comparison.
    """
    classes = events.filter(F.col("text").isNotNull() & F.col("day").isNotNull()).groupBy("text", "day").agg(F.min("event_id").alias("event_id"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    texts = classes.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("event_id", "day", "d0", "d1"))).alias("at"))
    texts = Steps(events.sparkSession).keep(texts)
    near = similar_pairs(texts.select(F.lit("").alias("grp"), F.col("text").alias("key"), lowered(F.col("text")).alias("t")), threshold).select(F.col("a").alias("text"), F.col("b").alias("text2"))
    near = near.unionByName(texts.filter(F.size("at") > 1).select("text", F.col("text").alias("text2")))
    b = texts.select(F.col("text").alias("text2"), F.col("at").alias("at2"))
    rows = near.join(texts, "text").join(b, "text2").select("text", "text2", F.explode("at").alias("a"), "at2").select("text", "text2", "a", F.explode("at2").alias("b"))
    rows = rows.filter("a.day <> b.day and not (a.d0 = a.d1 and b.d0 = b.d1 and a.d0 = b.d0) and (text <> text2 or a.event_id < b.event_id)")
    return rows.select(F.least("a.event_id", "b.event_id").alias("first"), F.greatest("a.event_id", "b.event_id").alias("second"))


# ------------------------------------------------------------------ intake
def contact_info(text: Column, most: int = 5) -> tuple[Column, Column]:
    phones = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), strip), lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 7)
    mails = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    return tuple(F.slice(F.sort_array(F.array_distinct(x)), 1, most) for x in (phones, mails))


def street_addresses(text: Column, most: int = 3) -> Column:
    """Street addresses in the text, sorted, then cut to ``most``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), strip)
    return F.slice(F.sort_array(F.array_distinct(found)), 1, most)


def matter_type(text: Column) -> tuple[Column, Column]:
    """(matter, confidence in hundredths): best list by counted words; its share of all hits."""
    name, best, total = best_class(text, MATTERS, "general", counted=True)
    return name, F.when(total > 0, F.floor(best * 100 / total + 0.5)).otherwise(0).cast("long")


def with_matter(intakes: DataFrame, text: str = "text") -> DataFrame:
    """``intakes`` with ``matter`` and ``confidence`` as of :func:`matter_type`, for which each text is counted once."""
    counted = intakes.withColumn("_m", best_class(F.col(text), MATTERS, "general", counted=True, whole=True))
    share = F.floor(F.col("_m.best") * 100 / F.col("_m.total") + 0.5)
    return counted.withColumns({"matter": F.col("_m.name"), "confidence": F.when(F.col("_m.total") > 0, share).otherwise(0).cast("long")}).drop("_m")


def name_variations(name: Column) -> Column:
    p = F.filter(F.split(strip(name), r"\s+"), lambda x: x != "")
    first, last, mid = p[0], F.element_at(p, -1), F.try_element_at(p, F.lit(2))
    two = F.array(name, last, F.concat(first, F.lit(" "), last), F.concat(F.substring(first, 1, 1), F.lit(". "), last), F.concat(last, F.lit(", "), first))
    three = F.when(F.size(p) >= 3, F.array(F.concat(first, F.lit(" "), F.substring(mid, 1, 1), F.lit(". "), last))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(p) < 2, F.array(name)).otherwise(F.array_distinct(F.concat(two, three)))


def infer_role(name: Column, text: Column) -> Column:
    """First role, in fixed order, one of whose words stands in a sentence with the name."""
    said = F.concat_ws("\n", F.filter(F.split(F.lower(text), r"[.!?]\s+"), lambda s: F.contains(s, F.lower(name))))
    out = F.lit("Unknown")
    for role, words in reversed(ROLES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | said.contains(w)
        out = F.when(hit, role).otherwise(out)
    return out


def limitation(matter: Column, jurisdiction: Column, incident: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(deadline, days left, level) by years of 365 days; null where a matter has no limit."""
    years = F.lit(None).cast("int")
    for m, by in LIMITATION_YEARS.items():
        own = F.lit(by["default"])
        for j, y in by.items():
            if j != "default":
                own = F.when(jurisdiction == j, y).otherwise(own)
        years = F.when(matter == m, own).otherwise(years)
    due = F.date_add(incident, (years * 365).cast("int"))
    left = F.datediff(due, as_of).cast("long")
    return due, left, F.when(left < 0, "expired").when(left < 30, "urgent").when(left < 90, "caution").when(left >= 90, "ok")


# Documents to ask for by matter and tier.
TIERS = ["critical", "important", "supplemental"]
CHECKLISTS = {
    "personal_injury": [
        ["Medical records from all treating providers", "Police/incident report", "Insurance policy declarations page", "Photos of injuries and accident scene", "Emergency room records"],
        ["Medical bills and payment records", "Proof of lost wages (pay stubs, employer letter)", "Health insurance EOBs", "Prescription records", "Physical therapy records", "Vehicle repair estimates/photos (if auto accident)", "Witness statements or contact information"],
        ["Prior medical records (pre-existing conditions)", "Surveillance footage", "Expert medical opinions", "Life care plan (if severe injury)", "Tax returns (for lost income verification)"],
    ],
    "family_law": [
        ["Marriage certificate", "Financial disclosure statements", "Most recent tax returns (3 years)", "Pay stubs (last 3 months)", "Bank statements (all accounts, last 6 months)"],
        ["Property deeds and mortgage statements", "Vehicle titles and loan statements", "Retirement/pension account statements", "Existing prenuptial or postnuptial agreements", "Custody or visitation agreements (if any)", "Children's birth certificates", "Health insurance cards"],
        ["Investment account statements", "Business ownership documents", "Debt statements (credit cards, loans)", "Social media evidence", "Communication records (texts, emails)", "School records for children"],
    ],
    "criminal_defense": [
        ["Arrest report and charging documents", "Bail/bond information", "Prior criminal history (if known)", "Police body camera or dashcam footage", "Witness statements from police report"],
        ["Employment verification", "Character reference letters", "Alibi evidence", "Medical records (if injury involved)", "Communication records relevant to charges", "Financial records (if financial crime)"],
        ["Rehabilitation records", "Community involvement documentation", "Military service records", "Educational records"],
    ],
    "immigration": [
        ["Valid passport (all pages)", "Current visa or immigration status documentation", "I-94 arrival/departure record", "Birth certificate with translation", "Employment authorization document (if applicable)"],
        ["Prior immigration filings and receipts", "Employment verification letter", "Pay stubs (last 3 months)", "Tax returns (last 3 years)", "Marriage certificate (if family-based)", "Spouse's citizenship/residency proof"],
        ["Educational diplomas and transcripts", "Professional certifications", "Photographs (passport-style)", "Affidavits of support", "Evidence of residence in the US", "Police clearance certificates"],
    ],
    "corporate": [
        ["Articles of incorporation / formation documents", "Operating agreement or bylaws", "Shareholder/member agreements", "Current contracts relevant to the matter", "Board minutes and resolutions"],
        ["Financial statements (last 3 years)", "Tax returns (business, last 3 years)", "Insurance policies (general liability, D&O)", "Employment agreements", "Non-compete/NDA agreements"],
        ["Intellectual property registrations", "Regulatory filings and licenses", "Prior legal opinions or memoranda", "Correspondence related to the matter"],
    ],
    "real_estate": [
        ["Property deed", "Purchase/sale agreement", "Title report or title insurance policy", "Mortgage documents", "Property survey"],
        ["Lease agreements (if rental property)", "HOA documents and bylaws", "Property tax statements", "Insurance policy", "Inspection reports", "Zoning and permit records"],
        ["Environmental reports", "Appraisal reports", "Correspondence with other parties", "Photos of property"],
    ],
    "employment": [
        ["Employment agreement/offer letter", "Termination letter or documentation", "Pay stubs (last 12 months)", "Employee handbook/policies", "Performance reviews"],
        ["Written warnings or disciplinary records", "Emails/communications about the dispute", "EEOC charge or complaint (if filed)", "Benefits documentation", "Non-compete or NDA agreements", "Company org chart"],
        ["Witness contact information", "Severance agreement (if offered)", "Social media evidence", "Job postings (for replacement evidence)", "Comparable salary data"],
    ],
    "estate_planning": [
        ["Existing will or trust documents", "List of all assets (real property, accounts, investments)", "List of all debts and liabilities", "Beneficiary designations (life insurance, retirement accounts)", "Government-issued ID"],
        ["Existing power of attorney documents", "Healthcare directive / living will", "Deed to real property", "Recent tax returns", "Life insurance policies", "Retirement account statements"],
        ["Business ownership documents", "Prenuptial/postnuptial agreements", "Divorce decrees", "Special needs trust documentation (if applicable)", "Charitable giving intentions"],
    ],
    "bankruptcy": [
        ["List of all creditors with amounts owed", "Bank statements (all accounts, last 6 months)", "Tax returns (last 2 years)", "Pay stubs (last 6 months)", "List of all assets and property"],
        ["Mortgage statements", "Vehicle loan statements", "Credit card statements (last 6 months)", "Collection letters and lawsuits", "Proof of expenses (utilities, rent, etc.)", "Previous bankruptcy filings (if any)"],
        ["Loan modifications or hardship letters", "Property appraisals", "Medical bills contributing to debt", "Retirement account statements"],
    ],
    "intellectual_property": [
        ["Registration certificates (patent, trademark, copyright)", "Application filings and correspondence", "Evidence of creation/invention (dates, records)", "Evidence of infringement", "Licensing agreements"],
        ["Prior art search results (patents)", "Market evidence (for damages)", "Correspondence with infringing party", "Business plans showing IP value", "Domain registration records"],
        ["Expert opinions or analyses", "Industry standards and practices", "International filings", "Social media evidence of infringement"],
    ],
    "general": [["Government-issued identification", "All relevant contracts and agreements", "Correspondence related to the matter"], ["Financial records", "Timeline of events", "Contact information for relevant parties"], []],
}
INCIDENT_WORDS = ["accident", "incident", "injury", "occurred", "happened", "event", "arrest", "terminated", "fired"]
OPPOSING_WORDS = ["against", "defendant", "opposing", "respondent", "vs", "versus"]
OPPOSING_FIELDS = ["opposing_party", "defendant", "respondent", "adverse_party"]


def checklist_rows() -> list[tuple[str, str, int, str]]:
    """(matter, tier, position, document) of the fixed lists."""
    return [(m, t, k, d) for m, tiers in CHECKLISTS.items() for t, docs in zip(TIERS, tiers) for k, d in enumerate(docs)]


def document_checklist(intakes: DataFrame, generic: str = "general") -> DataFrame:
    """Documents to ask for per intake (client_id, matter): (client_id, matter, tier, position, document) of its
    matter, or of ``generic`` where there is no list for it."""
    # never null, so that the join has no reason to work it out once more for a filter
    matter = F.coalesce(F.when(F.col("matter").isin(list(CHECKLISTS)), F.col("matter")), F.lit(generic))
    rows = intakes.sparkSession.createDataFrame(checklist_rows(), "matter string, tier string, position int, document string")
    return intakes.select("client_id", matter.alias("matter")).join(F.broadcast(rows), "matter").select("client_id", "matter", "tier", "position", "document")


def incident_date(text: Column, as_of: Column) -> Column:
    """The date of the incident: the first date of the text whose sentence names one, else the first date
    before ``as_of``; dates count in the order in which they stand."""
    found = F.array_sort(F.transform(dates_in(text), lambda d: F.struct(d["at"].alias("at"), d["day"].alias("day"), F.lower(sentence_around(text, d["raw"], d["at"])).alias("said"))))

    def first(found: Column) -> Column:
        named = F.filter(found, lambda d: d["said"].rlike("|".join(INCIDENT_WORDS)))
        past = F.filter(found, lambda d: d["day"] < as_of)
        return F.coalesce(F.try_element_at(named, F.lit(1))["day"], F.try_element_at(past, F.lit(1))["day"])

    # bound as an element of an array, so that the dates are found once
    return F.transform(F.array(found), first)[0]


def opposing_parties(persons: Column, client: Column, fields: Column | None = None) -> Column:
    """Distinct names, sorted: of ``persons`` (name, context) those but the client in whose context a word of
    opposition stands, and the values of the named fields of ``fields``, a map of strings."""
    out = F.transform(F.filter(persons, lambda p: F.lower(p["context"]).rlike("|".join(OPPOSING_WORDS)) & (p["name"] != client)), lambda p: p["name"])
    if fields is not None:
        out = F.concat(out, F.filter(F.array(*[F.try_element_at(fields, F.lit(f)) for f in OPPOSING_FIELDS]), lambda x: x.isNotNull() & (x != "")))
    return F.sort_array(F.array_distinct(out))


def conflict_list(names: DataFrame) -> DataFrame:
    """Names to check per client: (client_id, place, name, kind) of (client_id, at, name, kind): persons first, then
    organisations, each in order of ``at``; of names that differ in case only the first; two characters at least."""
    rows = names.withColumn("name", strip(F.col("name"))).filter(F.length("name") >= 2).withColumn("_k", F.when(F.col("kind") == "PERSON", 0).otherwise(1))
    first = rows.groupBy("client_id", F.lower("name").alias("_l")).agg(F.min(F.struct("_k", "at", "name", "kind")).alias("m"))
    w = Window.partitionBy("client_id").orderBy("m._k", "m.at", "m.name")
    return first.select("client_id", F.row_number().over(w).cast("long").alias("place"), "m.name", "m.kind")


# ------------------------------------------------------------------ structure and chunks
def detect_section(text: Column) -> Column:
    t = F.substring(text, 1, 80)
    caps = (F.length(text) < 100) & (F.upper(text) == text) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 2)
    return F.when(text.rlike(SECTION) | caps, strip(t)).otherwise("")


def running_section(df: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Last heading so far, ``Preamble`` before the first."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(detect_section(F.col("text")), F.lit(""))
    return df.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("Preamble")))


def clean_heading(text: Column) -> Column:
    x = strip(F.regexp_replace(text, r"\s+", " "))
    x = strip(F.regexp_replace(x, r"^[A-Z]?-?\d+\s+", ""))
    x = strip(F.regexp_replace(x, r"^#+\s*", ""))
    return F.when(x == "", "Untitled Section").otherwise(x)


def boundaries(blocks: DataFrame) -> DataFrame:
    """Section boundaries of blocks (doc_id, pos, text): confidence in hundredths, level, heading."""
    t = strip(F.col("text"))
    conf = F.lit(0)
    for p, c in reversed(BOUNDARIES):
        conf = F.when(t.rlike(p), c).otherwise(conf)
    numbers = F.regexp_extract(t, r"^\s*([\d.]+)", 1)
    depth = F.regexp_count(F.regexp_replace(numbers, r"\.+$", ""), F.lit(r"\.")) + 1
    level = F.when((conf > 0) & (numbers != ""), F.least(depth, F.lit(4))).otherwise(1)
    caps = (F.length(t) < 120) & (F.size(F.split(t, r"\s+")) >= 2) & (F.upper(t) == t) & ~t.startswith("[TABLE")
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = blocks.withColumn("_t", t).withColumn("_c", F.when(conf > 0, conf).when(caps, 70).otherwise(0)).withColumn("_l", level)
    rows = rows.withColumn("_k", F.row_number().over(w)).withColumn("_full", F.max(F.when(F.col("_t") != "", F.col("_k"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    blanks = F.col("_k") - F.coalesce("_full", F.lit(0)) - 1
    rows = rows.filter("_t <> ''").withColumn("confidence", F.when((F.col("_c") == 0) & (blanks >= 3), 30).otherwise(F.col("_c")))
    return rows.filter("confidence > 0").select("doc_id", "pos", clean_heading(F.substring("_t", 1, 120)).alias("heading"), F.col("_l").cast("long").alias("level"), F.col("confidence").cast("long").alias("confidence"))


def worth_chunking(docs: DataFrame, least: int = 50) -> DataFrame:
    """Documents (doc_id, text) of ``least`` characters or more, white space at the ends not counted."""
    return docs.filter(F.length(strip(F.col("text"))) >= least)


def chunk_mode(bounds: DataFrame, least: int = 3) -> DataFrame:
    return bounds.groupBy("doc_id").agg(F.sum((F.col("confidence") >= 70).cast("long")).alias("strong")).withColumn("mode", F.when(F.col("strong") >= least, "structure").otherwise("tokens"))


def count_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text: a quarter of its characters or, with the file of a byte-level vocabulary (lines of a token in
    base 64 and its rank), those that it is encoded in. Null texts have none."""
    if vocabulary is None:
        return F.floor(F.length(text) / 4).cast("long")
    count = counter(vocabulary)

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t)).astype("int64")

    return run(text)


#: Fixed value: how byte-level vocabularies split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict = {}


def counter(vocabulary: str | None) -> Callable[[str], int]:
    """A function that counts tokens; a vocabulary is read here and travels with it (under a megabyte)."""
    if vocabulary is None:
        return lambda t: len(t) // 4
    with open(vocabulary, "rb") as f:
        content = f.read()

    def count(text: str) -> int:
        if vocabulary not in _encodings:
            import base64

            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
            _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return len(_encodings[vocabulary].encode_ordinary(text))

    return count


def sentence_chunks(text: str, most: int, overlap: int, count=lambda s: len(s) // 4) -> Iterator[str]:
    """Chunks of whole sentences of at most ``most`` tokens; each starts with the last sentences of the one
    before, up to ``overlap`` tokens."""
    held: list[tuple[str, int]] = []
    fresh = False
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if not s:
            continue
        n = count(s)
        if fresh and sum(k for _, k in held) + n > most:
            yield " ".join(x for x, _ in held)
            tail, total = [], 0
            for x, k in reversed(held):
                if total + k > overlap:
                    break
                tail.insert(0, (x, k))
                total += k
            held, fresh = tail, False
        held.append((s, n))
        fresh = True
    if fresh:
        yield " ".join(x for x, _ in held)


def chunk_documents(docs: DataFrame, most: int = 4000, overlap: int = 200, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, chunk, text, tokens) of documents (doc_id, text); tokens as of :func:`count_tokens`."""
    count = counter(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, c, count(c)) for d, t in zip(b["doc_id"], b["text"]) for i, c in enumerate(sentence_chunks(t or "", most, overlap, count))]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text", "tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk bigint, text string, tokens bigint")


def page_estimates(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk, text) of documents of so many ``pages`` (doc_id, pages, n_chars) with an estimate
    of the pages that they stand on, by the characters before them."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    rows = chunks.withColumn("_before", before).withColumn("_n", n).join(pages, "doc_id")
    per = F.greatest(F.lit(1), F.floor(F.col("pages") / F.col("_n")))
    start = F.greatest(F.lit(1), F.floor(F.col("_before") * F.col("pages") / F.greatest(F.col("n_chars"), F.lit(1))) + 1)
    rows = rows.withColumn("start_page", start.cast("long")).withColumn("end_page", F.least(F.col("start_page") + per, F.col("pages")).cast("long"))
    return rows.drop("_before", "_n", "pages", "n_chars")


#: The heading of what stands before the first one.
PREAMBLE = "Preamble"
#: Chunks that a task hands on at once.
CHUNK_ROWS = 2000


def structure_chunks(sections: DataFrame, most: int = 4000, overlap: int = 200, small: int = 100, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, chunk, heading, text, tokens) of sections (doc_id, pos, heading, text).

    A section joins the chunk before it while that is under ``small`` tokens, or the sum under 0.8 of ``most``; headings
    are joined by slashes, but a chunk still under ``small`` takes the later one alone. A section above ``most`` is
    cut at sentences with ``overlap``, its parts numbered; a chunk before it that is under ``small`` goes in front of it.
    Null headings are the preamble's. Order is per document: rows come to a task sorted and are read one by one, so that a document
    costs by its sections and only its open chunk is held.
    """
    count = counter(vocabulary)

    def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
        """(doc_id, chunk, heading, text, tokens) of (doc_id, heading, text) in order."""
        held: list | None = None  # heading, texts, tokens
        doc, n_out = None, 0

        def out(heading: str, text: str, tokens: int) -> tuple:
            nonlocal n_out
            n_out += 1
            return doc, n_out - 1, heading, text, tokens

        for d, heading, text in rows:
            if d != doc:
                if held:
                    yield out(held[0], "\n\n".join(held[1]), held[2])
                held, doc, n_out = None, d, 0
            heading, text = heading or PREAMBLE, text or ""
            n = count(text)
            if n > most:
                if held and held[2] < small:
                    text = "\n\n".join([*held[1], text])
                elif held:
                    yield out(held[0], "\n\n".join(held[1]), held[2])
                held = None
                parts = list(sentence_chunks(text, most, overlap, count))
                for k, p in enumerate(parts, 1):
                    yield out(f"{heading} (part {k})" if len(parts) > 1 else heading, p, count(p))
            elif held and (held[2] < small or held[2] + n < 0.8 * most):
                held[1].append(text)
                held[2] += n
                if (held[0], heading) != (PREAMBLE, PREAMBLE):
                    held[0] = heading if held[2] < small else f"{held[0]} / {heading}"
            else:
                if held:
                    yield out(held[0], "\n\n".join(held[1]), held[2])
                held = [heading, [text], n]
        if held:
            yield out(held[0], "\n\n".join(held[1]), held[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "heading", "text"))))
        found = chunks(rows)
        while part := list(itertools.islice(found, CHUNK_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["doc_id", "chunk", "heading", "text", "tokens"])

    by_doc = sections.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "heading", "text").repartition("doc_id")
    by_doc = by_doc.sortWithinPartitions("doc_id", F.col("pos").asc_nulls_last()).select("doc_id", "heading", "text")
    return by_doc.mapInArrow(run, "doc_id bigint, chunk bigint, heading string, text string, tokens bigint")


def paragraph_chunks(text: Column, most: int = 100_000) -> Column:
    """Pieces of at most ``most`` characters that join to the text: each ends after the last paragraph break that fits
    in, else after the last end of a sentence (a full stop and a space), else where it is full. A null text has no pieces, an
    empty one has itself."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        def pieces(t: str | None) -> list[str]:
            if t is None:
                return []
            out, at = [], 0
            while len(t) - at > most:
                ends = (t.rfind(mark, at, at + most) for mark in ("\n\n", ". "))
                end = next((e + 2 for e in ends if e > at), at + most)
                out.append(t[at:end])
                at = end
            return [*out, t[at:]]

        return s.map(pieces)

    return cut(text)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, text): trimmed, non-empty, numbered among those."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("paragraph_index", "text"))


# ------------------------------------------------------------------ comparison
def change_risk(old: Column, new: Column) -> tuple[Column, Column]:
    """(risk, category) of a change."""
    both = F.lower(F.concat_ws(" ", old, new))
    high = both.rlike("(?i)" + "|".join(HIGH_RISK))
    medium = both.rlike("(?i)" + "|".join(MEDIUM_RISK))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    apart = F.size(F.array_except(words(old), words(new))) + F.size(F.array_except(words(new), words(old)))
    category = F.when(high & both.rlike("(?i)" + RISK_RELEVANT), "Risk-relevant").when(high | medium, "Substantive").when(apart <= 3, "Administrative").otherwise("Substantive")
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"), category


def with_risk(changes: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """``changes`` with ``risk`` and ``category`` as of :func:`change_risk`, each search of a text made once: words are told apart
    only where no risk is named."""
    once = lambda value, then: F.transform(F.array(value), then)[0]
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    verdict = lambda risk, category: F.struct(F.lit(risk).alias("risk"), (F.lit(category) if isinstance(category, str) else category).alias("category"))
    apart = once(
        F.struct(words(F.col(old)).alias("o"), words(F.col(new)).alias("n")),
        lambda w: F.size(F.array_except(w["o"], w["n"])) + F.size(F.array_except(w["n"], w["o"])),
    )

    def judged(both: Column) -> Column:
        relevant = F.when(both.rlike(RISK_RELEVANT), "Risk-relevant").otherwise("Substantive")
        high = both.rlike(_any_word(HIGH_RISK))
        medium = both.rlike(_any_word(MEDIUM_RISK))
        low = F.when(apart <= 3, "Administrative").otherwise("Substantive")
        return F.when(high, verdict("HIGH", relevant)).when(medium, verdict("MEDIUM", "Substantive")).otherwise(verdict("LOW", low))

    found = changes.withColumn("_r", once(F.lower(F.concat_ws(" ", F.col(old), F.col(new))), judged))
    return found.withColumns({"risk": F.col("_r.risk"), "category": F.col("_r.category")}).drop("_r")


def diff_documents(pairs: DataFrame) -> DataFrame:
    """Paragraph changes of document pairs (pair_id, old array<string>, new array<string>): type, old and new
    index, texts, number of changed words. One pair is one unit of work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, old, new in zip(b["pair_id"], b["old"], b["new"]):
                old, new = list(old), list(new)
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new).get_opcodes():
                    if tag == "equal":
                        continue
                    for k in range(max(i2 - i1, j2 - j1)):
                        o, n = (old[i1 + k] if i1 + k < i2 else None), (new[j1 + k] if j1 + k < j2 else None)
                        kind = "modified" if o is not None and n is not None else "deleted" if n is None else "added"
                        rows.append((pid, kind, i1 + k if o is not None else None, j1 + k if n is not None else None, o, n, len(list(word_changes(o, n))) if kind == "modified" else 0))
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["pair_id", "type", "old_index", "new_index", "old_text", "new_text", "word_changes"])
            yield out.astype({"old_index": "Int64", "new_index": "Int64"})

    return pairs.select("pair_id", "old", "new").mapInPandas(run, "pair_id bigint, type string, old_index bigint, new_index bigint, old_text string, new_text string, word_changes bigint")


def change_sections(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``changes`` (pair_id, old_index, new_index, ...) with ``section``: that of the old paragraph with this index,
    else of the new one, else ``Unknown``. ``old``, ``new``: (pair_id, index, section). All three are counted: give tables
    as read. A task joins so many rows, however large they are."""
    o = old.select("pair_id", F.col("index").alias("old_index"), F.col("section").alias("_o"))
    n = new.select("pair_id", F.col("index").alias("new_index"), F.col("section").alias("_n"))
    tasks = tasks_of(changes, old, new)
    rows = changes
    for side, index in ((o, "old_index"), (n, "new_index")):
        rows = rows.repartition(tasks, "pair_id", index).join(side.repartition(tasks, "pair_id", index), ["pair_id", index], "left")
    return rows.withColumn("section", F.coalesce("_o", "_n", F.lit("Unknown"))).drop("_o", "_n")


def section_stats(changes: DataFrame) -> DataFrame:
    """Per pair and section: additions, deletions, modifications, total, and ``place`` in order of total (ties by
    name); the most changed sections are those of the first places."""
    kinds = {"additions": "added", "deletions": "deleted", "modifications": "modified"}
    # pairs are dealt over as many tasks as the rows need; a task counts and ranks its own
    changes = Steps(changes.sparkSession).keep(changes.select("pair_id", "section", "type"))
    changes = changes.repartition(tasks_of(changes), "pair_id")
    by = changes.groupBy("pair_id", "section").agg(*[F.count(F.when(F.col("type") == k, 1)).alias(n) for n, k in kinds.items()], F.count(F.lit(1)).alias("total"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("total").desc(), "section")).cast("long"))


def percent_changed(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, changes, changed_milli): changes per thousand of the longer side's paragraphs; 0 of none."""
    n = changes.groupBy("pair_id").agg(F.count(F.lit(1)).alias("changes"))
    most = F.greatest(F.size("old"), F.size("new"))
    rows = pairs.select("pair_id", most.alias("_m")).join(n, "pair_id", "left").fillna(0, ["changes"])
    return rows.select("pair_id", "changes", F.when(F.col("_m") > 0, F.floor(F.col("changes") * 1000 / F.col("_m") + 0.5)).otherwise(0).cast("long").alias("changed_milli"))


def word_changes(old: str, new: str) -> Iterator[tuple[str, list[str], list[str]]]:
    a, b = old.split(), new.split()
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            yield tag, a[i1:i2], b[j1:j2]


def similarity(a: Column, b: Column) -> Column:
    """The ratio of two texts in lower case, null as empty; equal pairs of a batch are compared once."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [((p or "").lower(), (q or "").lower()) for p, q in zip(x, y)]
        found = {p: _ratio(*p) for p in set(pairs)}
        return pd.Series([found[p] for p in pairs], dtype="float64")

    return ratio(a, b)


# ------------------------------------------------------------------ entities
def normal_name(raw: Column) -> Column:
    x = F.regexp_replace(strip(raw), HONORIFICS, "")
    x = F.regexp_replace(x, r"""^[\s.,;:"']+|[\s.,;:"']+$""", "")
    return F.regexp_replace(x, r"\s+", " ")


def mentions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("label").isin(ENTITY_LABELS)).withColumn("name", normal_name(F.col("raw_name"))).filter("name <> ''")


def entity_index(m: DataFrame, least: int = 1, contexts: int = 5) -> DataFrame:
    """Per (name, label): mentions, documents, first context and the first ``contexts`` of them (by document,
    paragraph, text). Contexts are ranked within a bounded number per key, so a name of every page is no
    large group."""
    by = m.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.min(F.struct("doc_id", "paragraph_index", "context")).alias("f")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("name", "label").orderBy("doc_id", "paragraph_index", "context"))
    top = m.select("name", "label", "doc_id", "paragraph_index", "context").withColumn("k", rank).filter(F.col("k") <= contexts)
    top = top.groupBy("name", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("context", F.lit("")).alias("c")))), lambda x: x["c"]).alias("contexts"))
    return by.join(top, ["name", "label"]).select("name", "label", "n", "documents", F.col("f.context").alias("first_context"), "contexts")


def top_entities(m: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` names with most mentions, ties by name and label."""
    return m.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name", "label").limit(most)


def extracts(m: DataFrame, label: str) -> DataFrame:
    """All mentions of one label (such as DATE or MONEY) with context and document."""
    return m.filter(F.col("label") == label).select("name", "context", "doc_id", "paragraph_index")


def cooccurrence(m: DataFrame) -> DataFrame:
    """Pairs of different names in one paragraph; each paragraph counts once."""
    rows = m.select("doc_id", "paragraph_index", "name").distinct()
    b = rows.withColumnRenamed("name", "other")
    return rows.join(b, ["doc_id", "paragraph_index"]).filter("name < other").groupBy(F.col("name").alias("src"), F.col("other").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def canonical_names(m: DataFrame, least: int = 3) -> DataFrame:
    """(label, name, canonical): longest first, a shorter name held by a canonical one joins it.

    What is held by a name that is itself held, is held by the outer one too, so the canonical name is the
    first, longest first, of all names that hold it. Names are made distinct; a name is compared with those
    that have its rarest run of three letters, so no label is one task's.
    """
    names = m.select("label", "name").distinct().withColumn("low", F.lower("name"))
    runs = F.when(F.length("low") >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring(F.col("low"), i, F.lit(3)))))
    grams = names.withColumn("gram", F.explode(runs))
    often = grams.groupBy("label", "gram").agg(F.count(F.lit(1)).alias("k"))
    rare = grams.filter(F.length("name") >= least).join(often, ["label", "gram"]).groupBy("label", "name").agg(F.min(F.struct("k", "gram")).alias("r"), F.first("low").alias("low")).select("label", "name", "low", F.col("r.gram").alias("gram"))
    outer = grams.select("label", "gram", F.col("name").alias("other"), F.col("low").alias("other_low"))
    longer = (F.length("other") > F.length("name")) | ((F.length("other") == F.length("name")) & (F.col("other") < F.col("name")))
    held = rare.join(outer, ["label", "gram"]).filter(longer & F.col("other_low").contains(F.col("low")))
    home = held.groupBy("label", "name").agg(F.min(F.struct((-F.length("other")).alias("n"), F.col("other").alias("o"))).alias("h"))
    return names.select("label", "name").join(home, ["label", "name"], "left").select("label", "name", F.coalesce("h.o", "name").alias("canonical"))


RULES = {"MONEY": r"\$\s?\d[\d,]*(?:\.\d+)?", "DATE": rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b", "ORG": r"\b(?:[A-Z][\w&]+\s+)+(?:Inc|LLC|LLP|Corp|Ltd|Company)\b\.?", "PERSON": r"\b(?:Mr|Mrs|Ms|Dr|Judge)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?",
         "LAW": r"\b\d+\s+U\.?S\.?C\.?\s+(?:§+\s*)?\d+[\w()]*|\bSection\s+\d+[\w()]*\s+of\s+the\s+(?:[A-Z]\w+\s+)+Act\b",
         "GPE": r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*,\s(?:A[LKZR]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\b"}


def _labelled(kind: str):
    return lambda x: F.struct(x.alias("raw_name"), F.lit(kind).alias("label"))


def extract_entities(paras: DataFrame) -> DataFrame:
    """Rule-based mentions of paragraphs (doc_id, paragraph_index, text); a model can take its place."""
    hits = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _labelled(k)) for k, p in RULES.items()])
    return paras.withColumn("_e", F.explode(hits)).select("doc_id", "paragraph_index", "_e.raw_name", "_e.label", F.substring("text", 1, 300).alias("context"))


def _named_title(who: str, title: str):
    return lambda r: F.struct(F.regexp_extract(r, who, 1).alias("name"), F.regexp_extract(r, f"({title})$", 1).alias("title"))


def officers(text: Column) -> Column:
    """(name, title) of officers named before their titles."""
    who = r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+(?:\s+(?:Jr\.|Sr\.|III|IV|II))?)[\s,\-]+"
    parts = []
    for t in OFFICER_TITLES:
        raws = F.regexp_extract_all(text, F.lit(f"{who}(?:{t})"), F.lit(0))
        parts.append(F.transform(raws, _named_title(who, t)))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, 50)
