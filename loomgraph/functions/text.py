"""Text functions as Column expressions; they stay in the JVM but for NFC of texts that may need it."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.config import LABEL_ALIASES, STOP_WORDS

#: Fixed value: what a token is.
TOKEN = "[a-z0-9][a-z0-9\\-]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(text: Column | str) -> Column:
    """NFC; a text without characters from U+0300 on is in that form already and never leaves the JVM."""
    text = col(text)
    doubtful = F.when(text.rlike(r"[^\u0000-˿]"), text)
    return F.coalesce(_nfc(doubtful), text)


def collapse(text: Column | str) -> Column:
    """Line ends to LF, runs of blanks to one, no blanks at line ends, at most one empty line, stripped."""
    text = F.regexp_replace(col(text), "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n)", "")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(text)


def normalize_text(text: Column | str) -> Column:
    return collapse(nfc(text))


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def tokens(text: Column | str) -> Column:
    """All tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def terms(text: Column | str, least: int = 3) -> Column:
    """Distinct tokens of at least so many characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least))


def content_tokens(text: Column | str) -> Column:
    """Distinct terms without stop words."""
    return F.array_except(terms(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def normalize_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "")


def name_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(normalize_name(a), normalize_name(b))


def string_similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal normalised names, otherwise 1 - distance / longer length."""
    x, y = normalize_name(a), normalize_name(b)
    longer = F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when(x == y, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longer)


def normalize_label(label: Column | str) -> Column:
    """First letter upper, rest lower; known synonyms to their label; anything unknown is a Concept."""
    from loomgraph.config import ENTITY_LABELS

    label = strip(label)
    shown = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substring(label, 2, 1 << 30)))
    known = F.create_map(*[F.lit(x) for pair in LABEL_ALIASES.items() for x in pair])
    mapped = F.coalesce(F.try_element_at(known, shown), shown)
    return F.when(mapped.isin(ENTITY_LABELS), mapped).otherwise("Concept")


def fuzzy_overlap(query: Column, target: Column) -> Column:
    """How many query terms equal, contain or lie within some target term."""
    return F.size(F.filter(query, lambda q: F.exists(target, lambda t: F.contains(t, q) | F.contains(q, t))))


def lexical_f1(a: Column | str, b: Column | str) -> Column:
    """F1 of content-token sets; 1 when both are empty."""
    x, y = content_tokens(a), content_tokens(b)
    both = F.size(F.array_intersect(x, y))
    p, r = F.try_divide(both, F.size(x)), F.try_divide(both, F.size(y))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(f1)


def key_fact_recall(answer: Column | str, facts: Column | str, threshold: float = 0.6) -> Column:
    """Share of facts of which enough content tokens are tokens or substrings of the answer; 1 without facts."""
    answer, facts = col(answer), col(facts)
    low = F.lower(answer)

    def recalled(fact: Column) -> Column:
        own = content_tokens(fact)
        present = F.size(F.filter(own, lambda t: F.contains(low, t)))
        return (F.size(own) > 0) & (F.coalesce(F.try_divide(present, F.size(own)), F.lit(0.0)) >= threshold)

    share = F.try_divide(F.size(F.filter(facts, recalled)), F.size(facts))
    return F.when(F.coalesce(F.size(facts), F.lit(0)) <= 0, 1.0).otherwise(share)


def cite(span: Column | str) -> Column:
    """`kind start[–end][ (label)]`."""
    span = col(span)
    end = F.when(span["end"] != span["start"], F.concat(F.lit("–"), span["end"].cast("string"))).otherwise("")
    label = F.when(F.coalesce(span["label"], F.lit("")) != "", F.concat(F.lit(" ("), span["label"], F.lit(")"))).otherwise("")
    return F.concat(span["kind"], F.lit(" "), span["start"].cast("string"), end, label)


def span_to_json(span: Column | str) -> Column:
    """A span as JSON text with all its fields."""
    return F.to_json(col(span), {"ignoreNullFields": "false"})


def span_from_json(raw: Column | str) -> Column:
    """The span of a JSON text; missing fields, and a missing or broken text, give line 0 to 0 without label."""
    got = F.from_json(col(raw), "kind string, start int, end int, label string")
    part = lambda f, otherwise: F.coalesce(got[f], F.lit(otherwise)).alias(f)
    return F.struct(part("kind", "line"), part("start", 0), part("end", 0), got["label"].alias("label"))


#: Fixed value: the characters that have a meaning in the query language of Lucene.
LUCENE = r"""[+\-&|!(){}\[\]^"~*?:\\/]"""


def escape_query(text: Column | str) -> Column:
    """A text as a literal Lucene query, for full-text services beside this engine; an empty one asks for anything."""
    escaped = F.regexp_replace(col(text), f"({LUCENE})", r"\\$1")
    return F.when(escaped == "", "*").otherwise(escaped)


def markdown_title(text: Column | str, otherwise: Column | str) -> Column:
    """The first line that starts with `# `, else the other."""
    found = F.regexp_extract(col(text), "(?m)^# (.*)$", 1)
    return F.when(col(text).rlike("(?m)^# "), strip(found)).otherwise(col(otherwise))


def markdown_links(text: Column | str) -> Column:
    """Sorted distinct targets of wiki links and of markdown links that are not anchors."""
    text = col(text)
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    plain = F.filter(F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1)), lambda x: ~x.startswith("#"))
    return F.array_sort(F.array_distinct(F.concat(wiki, plain)))


def safe_json(raw: Column | str) -> Column:
    """From the first { to the last }, parsed; null where there is none."""
    raw = col(raw)
    return F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0))


def parse_order(raw: Column | str, most: Column | int) -> Column:
    """Passage numbers of a ranking answer: those of its list, else all whole numbers of the prose."""
    raw = strip(raw)
    listed = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    parsed = F.from_json(listed, "array<string>")
    numbers = F.filter(parsed, lambda x: F.trim(x).rlike(r"^-*\d+$"))
    loose = F.slice(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), 1, most)
    return F.transform(F.coalesce(numbers, loose), lambda x: F.trim(x).try_cast("int"))


def clamp5(x: Column | str) -> Column:
    return F.coalesce(F.least(F.greatest(col(x).try_cast("double"), F.lit(0.0)), F.lit(5.0)), F.lit(0.0))


def expansion_terms(query: Column | str, answer: Column | str, most: int = 6) -> Column:
    """Terms of a comma or line list that the query does not hold yet, distinct whatever their case."""
    query = col(query)
    cleaned = F.transform(F.split(col(answer), "[,\n;]+"), lambda t: strip(F.regexp_replace(strip(t), "^[-•*\"']+|[-•*\"']+$", "")))
    fresh = F.filter(cleaned, lambda t: (t != "") & ~F.contains(F.lower(query), F.lower(t)))

    def step(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t)))

    return F.slice(F.aggregate(fresh, F.array().cast("array<string>"), step), 1, most)


def expanded_query(query: Column | str, answer: Column | str, most: int = 6) -> Column:
    return F.array_join(F.concat(F.array(col(query)), expansion_terms(query, answer, most)), " ")
