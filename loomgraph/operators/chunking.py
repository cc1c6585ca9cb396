"""Structure-aware chunking: segments by page, turn or heading, then windows of sentences with overlap.

One document becomes its array of chunks in one expression, so chunking needs no shuffle and the position is
the place in that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.folds import folded
from loomgraph.functions.text import col, strip

# What opens a section, and where a sentence ends.
HEADING = r"#{1,6}[^\S\n]"
SENTENCE = r"(?U)(?<=[.!?])\s+"
_SEGMENT = "struct<label:string,start:int,text:string>"
_WINDOW = "struct<text:string,low:int,high:int,before:int,within:int>"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of(text: Column | str, offset: Column | int, start: Column | int = 1) -> Column:
    """The line on which the character after offset stands, in a text whose first line is start."""
    first = start if isinstance(start, Column) else F.lit(start)
    return (first + _newlines(F.left(col(text), offset if isinstance(offset, Column) else F.lit(offset)))).cast("int")


def sections(text: Column | str) -> Column:
    """Markdown sections as (label, start line, text): each heading opens one."""
    parts = F.split(col(text), rf"\n(?={HEADING})")

    def step(acc: Column, part: Column) -> tuple[Column, dict[str, Column]]:
        head = F.substring_index(part, "\n", 1)
        label = F.when(head.rlike(f"^{HEADING}"), strip(F.regexp_replace(head, f"^{HEADING}", "")))
        own = F.struct(label.alias("label"), acc["line"].alias("start"), part.alias("text"))
        return F.array(own), {"line": (acc["line"] + _newlines(part) + 1).cast("int")}

    return folded(parts, _SEGMENT, {"line": F.lit(1)}, step)["out"]


def _marked(text: Column, kind: str) -> tuple[Column, Column]:
    """Numbers of [[KIND n]] marks and the text after each."""
    mark = rf"\[\[{kind} (\d+)\]\]"
    numbers = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    bodies = F.split(text, mark, -1)
    return numbers, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0)))


def pages(text: Column | str) -> Column:
    numbers, bodies = _marked(col(text), "PAGE")
    return F.zip_with(numbers, bodies, lambda n, b: F.struct(F.concat(F.lit("p."), n).alias("label"), n.cast("int").alias("start"), b.alias("text")))


def turns(text: Column | str) -> Column:
    numbers, bodies = _marked(col(text), "TURN")

    def own(n: Column, b: Column) -> Column:
        b = strip(b)
        speaker = F.when(F.contains(F.left(b, F.lit(40)), F.lit(":")), strip(F.substring_index(b, ":", 1)))
        return F.struct(speaker.alias("label"), n.cast("int").alias("start"), b.alias("text"))

    return F.zip_with(numbers, bodies, own)


def windows(text: Column | str, size: int, overlap: int) -> Column:
    """Windows over sentences as (text, low, high, before, within), with offsets into the text and the line breaks before either offset.

    A window closes when the next sentence would make it longer than size; the next one starts with the last
    overlap characters. A single sentence is never cut. Offsets and line breaks are carried from sentence to sentence, so no part of the
    text is looked at again for a later window.
    """
    text = col(text)
    stripped = strip(text)
    sentences = F.split(stripped, SENTENCE)
    gaps = F.concat(F.regexp_extract_all(stripped, F.lit(f"({SENTENCE})"), F.lit(1)), F.array(F.lit("")))
    pairs = F.arrays_zip(sentences.alias("s"), gaps.alias("g"))
    margin = F.regexp_extract(text, r"(?U)^\s+", 0)
    lead = F.length(margin)
    window = lambda acc: F.array(F.struct(acc["buf"].alias("text"), acc["low"].alias("low"), acc["high"].alias("high"), acc["before"].alias("before"), acc["within"].alias("within")))
    none = F.array().cast(f"array<{_WINDOW}>")

    def step(acc: Column, x: Column) -> tuple[Column, dict[str, Column]]:
        sentence, gap = x["s"], F.coalesce(x["g"], F.lit(""))
        end = (acc["at"] + F.length(sentence)).cast("int")
        after = (end + F.length(gap)).cast("int")
        breaks = (acc["breaks"] + _newlines(sentence)).cast("int")
        tail = F.right(acc["buf"], F.lit(overlap)) if overlap else F.lit("")
        flush = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(sentence) + 1 > size)
        buf = F.when(flush, strip(F.concat(tail, F.lit(" "), sentence))).when(acc["buf"] == "", sentence).otherwise(strip(F.concat(acc["buf"], F.lit(" "), sentence)))
        low = F.when(flush, F.greatest(F.lit(0), acc["at"] - F.length(tail))).otherwise(acc["low"]).cast("int")
        # the text just before the sentence, as long as an overlap can be
        seen = F.right(F.concat(acc["seen"], sentence, gap), F.lit(overlap)) if overlap else F.lit("")
        before = F.when(flush, acc["breaks"] - _newlines(F.right(acc["seen"], F.length(tail)))).otherwise(acc["before"]).cast("int")
        return F.when(flush, window(acc)).otherwise(none), {"buf": buf, "low": low, "high": end, "before": before, "within": breaks, "at": after, "breaks": (breaks + _newlines(gap)).cast("int"), "seen": seen}

    first = _newlines(margin).cast("int")
    start = {"buf": F.lit(""), "low": lead, "high": lead, "before": first, "within": first, "at": lead, "breaks": first, "seen": F.right(margin, F.lit(overlap)) if overlap else F.lit("")}
    finished = F.transform(F.array(folded(pairs, _WINDOW, start, step)), lambda acc: F.when(acc["buf"] != "", F.concat(acc["out"], window(acc))).otherwise(acc["out"]))
    whole = F.array(F.struct(stripped.alias("text"), F.lit(0).alias("low"), F.length(text).alias("high"), F.lit(0).alias("before"), _newlines(text).cast("int").alias("within")))
    return F.when(F.length(stripped) <= size, whole).otherwise(F.get(finished, 0))


def chunk_array(source_type: Column, text: Column, size: int, overlap: int) -> Column:
    """The document's chunks as an array of (text, span)."""
    paged = (source_type == "pdf") & text.rlike(r"\[\[PAGE \d+\]\]")
    turned = (source_type == "transcript") & text.rlike(r"\[\[TURN \d+\]\]")
    kind = F.when(paged, "page").when(turned, "turn").otherwise("line")
    segments = F.when(paged, pages(text)).when(turned, turns(text)).otherwise(sections(text))

    def of_segment(seg: Column) -> Column:
        def of_window(w: Column) -> Column:
            line = lambda breaks: F.when(paged | turned, seg["start"]).otherwise(seg["start"] + breaks).cast("int")
            low, high = line(w["before"]), line(w["within"])
            span = F.struct(kind.alias("kind"), low.alias("start"), high.alias("end"), seg["label"].alias("label"))
            return F.struct(strip(w["text"]).alias("text"), span.alias("span"))

        return F.transform(windows(seg["text"], size, overlap), of_window)

    return F.filter(F.flatten(F.transform(segments, of_segment)), lambda c: c["text"] != "")


def chunk_documents(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """id `document:position`, document_id, position, text and span of every non-blank chunk.

    docs: id, source_type, raw_text. Null text has no chunks.
    """
    chunks = chunk_array(F.coalesce("source_type", F.lit("")), F.coalesce("raw_text", F.lit("")), size, overlap)
    out = docs.select(F.col("id").alias("document_id"), F.posexplode(chunks).alias("position", "c"))
    return out.select(F.concat_ws(":", "document_id", F.col("position").cast("string")).alias("id"), "document_id", "position", "c.text", "c.span")
