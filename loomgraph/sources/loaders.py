"""Sources: folders of notes, transcripts, PDFs, web pages, gold sets and alias seeds as DataFrames.

Every loader returns the documents schema (loomgraph.schemas) without a hash; ids are hashes of the uri, so a
second run gives the same ids. Files are listed and read by Spark, so any store Spark reads will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.config import ALIAS_SEEDS
from loomgraph.frames import in_small_batches, stacked, trim
from loomgraph.functions.folds import folded
from loomgraph.functions.text import col, markdown_links, markdown_title, strip
from loomgraph.schemas import GOLD, QUESTION

# The line that opens a turn of a transcript.
TURN = r"^(?:\[([^\]]+)\]\s*)?([A-Za-z0-9 _.-]{1,40}):\s*(.*)$"


def document_id(uri: Column | str) -> Column:
    return F.left(F.sha2(col(uri).cast("binary"), 256), F.lit(32))


def source_type(path: Column | str) -> Column:
    """By suffix; null for what cannot be loaded."""
    low = F.lower(col(path))
    return F.when(low.rlike(r"(\.transcript\.txt|\.vtt|\.srt)$"), "transcript").when(low.rlike(r"\.(md|markdown|txt)$"), "markdown").when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.html?$"), "web")


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(col(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and source_type of the files of a folder with a listed suffix (or of one file); their order is that of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    listed = files.where(F.lower("path").rlike(r"\.(md|markdown|txt|pdf|vtt|srt|html?)$"))
    return listed.withColumn("source_type", source_type("path"))


def _documents(rows: DataFrame) -> DataFrame:
    """Fills in what all loaders share; rows: uri, source_type, title, raw_text, links, meta."""
    return rows.select(
        document_id("uri").alias("id"), "source_type", "uri", "title", "raw_text", F.current_timestamp().alias("created_at"),
        F.lit(None).cast("string").alias("content_hash"), F.lit(1).alias("version"), F.lit(1).alias("schema_version"), "links", "meta",
    )


def load_markdown(files: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8")
    rows = files.withColumn("raw_text", text)
    return _documents(rows.select(F.col("path").alias("uri"), "source_type", markdown_title("raw_text", stem("path")).alias("title"), "raw_text", markdown_links("raw_text").alias("links"), F.create_map(F.lit("path"), F.col("path")).alias("meta")))


def transcript(text: Column | str) -> tuple[Column, Column]:
    """The text with a [[TURN n]] mark before each turn, and the number of turns; unchanged without turns.

    A line `speaker: text` (after an optional [timestamp]) opens a turn; other lines continue it.
    """
    text = col(text)
    state = {"n": F.lit(0), "speaker": F.lit(None).cast("string"), "buf": F.lit("")}
    turn = lambda acc: F.array(F.concat(F.lit("[[TURN "), acc["n"].cast("string"), F.lit("]] "), acc["speaker"], F.lit(": "), strip(acc["buf"])))
    none = F.array().cast("array<string>")

    def step(acc: Column, raw: Column) -> tuple[Column, dict[str, Column]]:
        line = strip(raw)
        opens = line.rlike(TURN)
        return F.when(opens & acc["speaker"].isNotNull(), turn(acc)).otherwise(none), {
            "n": F.when(opens, acc["n"] + 1).otherwise(acc["n"]),
            "speaker": F.when(opens, strip(F.regexp_extract(line, TURN, 2))).otherwise(acc["speaker"]),
            "buf": F.when(opens, strip(F.regexp_extract(line, TURN, 3))).when(line == "", acc["buf"]).otherwise(F.concat(acc["buf"], F.lit(" "), line)),
        }

    last = folded(F.split(text, "\r\n|\r|\n"), "string", state, step)
    turns = F.get(F.transform(F.array(last), lambda acc: F.when(acc["speaker"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], turn(acc)))), 0)
    return F.when(F.size(turns) > 0, F.array_join(turns, "\n")).otherwise(text), F.size(turns)


def load_transcript(files: DataFrame) -> DataFrame:
    marked, n = transcript(F.decode("content", "UTF-8"))
    meta = F.create_map(F.lit("path"), F.col("path"), F.lit("turns"), n.cast("string"))
    return _documents(files.select(F.col("path").alias("uri"), "source_type", stem("path").alias("title"), marked.alias("raw_text"), F.array().cast("array<string>").alias("links"), meta.alias("meta")))


class Page(HTMLParser):
    """A tolerant tree of a page: an end tag closes its nearest open element, elements without one stay open."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    DROPPED = frozenset("script style nav header footer aside".split())

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root: dict = {"name": "", "attrs": {}, "kids": []}
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "attrs": dict(attrs), "kids": []}
        self.open[-1]["kids"].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1]["kids"].append({"name": tag, "attrs": dict(attrs), "kids": []})

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k]["name"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1]["kids"].append(data)

    def walk(self, node: dict | None = None) -> Iterator[dict]:
        """Elements below the node in document order, without dropped ones."""
        stack = list(reversed((node or self.root)["kids"]))
        while stack:
            kid = stack.pop()
            if isinstance(kid, dict) and kid["name"] not in self.DROPPED:
                yield kid
                stack += reversed(kid["kids"])

    def strings(self, node: dict) -> Iterator[str]:
        stack = list(reversed(node["kids"]))
        while stack:
            kid = stack.pop()
            if isinstance(kid, str):
                yield kid
            elif kid["name"] not in self.DROPPED:
                stack += reversed(kid["kids"])


def readable(html: str | None) -> dict:
    """title, text and links of a page: headings, paragraphs and list items of its article, main part or body."""
    page = Page(html or "")
    first = {}
    for node in page.walk():
        first.setdefault(node["name"], node)
    title = ""
    if "title" in first and len(first["title"]["kids"]) == 1 and isinstance(first["title"]["kids"][0], str):
        title = first["title"]["kids"][0].strip()
    root = first.get("article") or first.get("main") or first.get("body") or page.root
    parts, links = [], set()
    for node in page.walk(root):
        if node["name"] in ("h1", "h2", "h3", "p", "li"):
            text = " ".join(s.strip() for s in page.strings(node) if s.strip())
            if text:
                parts.append(("# " if node["name"] == "h1" else "## " if node["name"] in ("h2", "h3") else "") + text)
        elif node["name"] == "a" and (node["attrs"].get("href") or "").startswith("http"):
            links.add(node["attrs"]["href"])
    return {"title": title, "text": "\n\n".join(parts), "links": sorted(links)}


_PAGE = T.StructType().add("title", T.StringType()).add("text", T.StringType()).add("links", T.ArrayType(T.StringType()))


#: Pages whose results stand as Python objects at once.
_PAGES = 64


@F.arrow_udf(_PAGE)
def readability(html: pa.Array) -> pa.Array:
    kind = pa.struct([("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string()))])
    parts = [pa.array([], kind)]
    for first in range(0, len(html), _PAGES):
        parts.append(pa.array([readable(h.as_py()) for h in html.slice(first, _PAGES)], kind))
    trim()
    return pa.concat_arrays(parts)


def load_web(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Documents of pages; a worker holds a batch of a few MB of them, and the tree of one page at a time."""
    rows = in_small_batches(pages).select(F.col(url).alias("uri"), readability(html).alias("r"))
    title = F.when(F.col("r.title") != "", F.col("r.title")).otherwise(F.col("uri"))
    return _documents(rows.select("uri", F.lit("web").alias("source_type"), title.alias("title"), F.col("r.text").alias("raw_text"), F.col("r.links").alias("links"), F.create_map(F.lit("url"), F.col("uri")).alias("meta")))


PdfParser = Callable[[bytes], tuple[str, list[str]]]


def load_pdf(files: DataFrame, parser: PdfParser | None = None) -> DataFrame:
    """Each page's text after its [[PAGE n]] mark. parser: bytes to (title, texts of pages); PyMuPDF where installed.

    A file that cannot be parsed has an empty text and the error in meta.
    """
    from loomgraph.providers import mapped

    def parse(content: bytes) -> tuple[str, list[str]]:
        if parser is not None:
            return parser(content)
        import fitz

        with fitz.open(stream=content, filetype="pdf") as pdf:
            return (pdf.metadata or {}).get("title") or "", [p.get_text() for p in pdf]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = mapped(parse, [bytes(c) for c in batch["content"]], 1)
            parsed = [t or ("", []) for t, _ in told]
            text = ["\n".join(f"[[PAGE {i}]]\n{t}" for i, t in enumerate(pages, 1)) for _, pages in parsed]
            yield pd.DataFrame({"path": batch["path"], "source_type": batch["source_type"], "found": [t for t, _ in parsed], "raw_text": text, "n": [len(p) for _, p in parsed], "error": [e for _, e in told]})

    rows = files.select("path", "content", "source_type").mapInPandas(run, "path string, source_type string, found string, raw_text string, n int, error string")
    title = F.when(strip("found") != "", strip("found")).otherwise(stem("path"))
    meta = F.map_filter(F.create_map(F.lit("path"), F.col("path"), F.lit("pages"), F.col("n").cast("string"), F.lit("error"), F.col("error")), lambda _, v: v.isNotNull())
    return _documents(rows.select(F.col("path").alias("uri"), "source_type", title.alias("title"), "raw_text", F.array().cast("array<string>").alias("links"), meta.alias("meta")))


def load_folder(spark: SparkSession, path: str, pdf_parser: PdfParser | None = None) -> DataFrame:
    """All documents of a folder, each file by its kind; `.html` files too."""
    files = read_files(spark, path)
    of = lambda kind: files.where(F.col("source_type") == kind)
    html = of("web").select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))
    out = stacked(stacked(load_markdown(of("markdown")), load_transcript(of("transcript"))), load_web(html))
    return stacked(out, load_pdf(of("pdf"), pdf_parser))


def load_path(spark: SparkSession, path: str, pdf_parser: PdfParser | None = None) -> DataFrame:
    """One file by its kind, or a folder; ValueError for a file of a kind that cannot be loaded."""
    suffix = path.rsplit("/", 1)[-1].lower().rpartition(".")
    if suffix[0] and suffix[2] not in ("md", "markdown", "txt", "pdf", "vtt", "srt", "htm", "html"):
        raise ValueError(f"files like {path} cannot be loaded")
    return load_folder(spark, path, pdf_parser)


def fetched(url: str, seconds: float = 30.0) -> str:
    """The page at url; redirects are followed."""
    from urllib.request import urlopen

    with urlopen(url, timeout=seconds) as page:
        return page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str] = fetched, calls: int = 4) -> DataFrame:
    """url, html and error of urls (url); pages are fetched on the executors, and one that fails has an error instead of html."""
    from loomgraph.providers import with_calls

    return with_calls(urls.select("url"), "url", fetch, "html", T.StringType(), calls)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: corpus and arrays of retrieval, extraction and resolution cases; JSON, or YAML where a reader is installed."""
    if path.lower().endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML reader is installed; write the gold set as JSON") from e
        raw = json.dumps(yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]))
        return spark.createDataFrame([(raw,)], "raw string").select(F.from_json("raw", GOLD).alias("g")).select("g.*")
    return spark.read.schema(GOLD).json(path, multiLine=True)


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """Questions of `{"questions": [...]}` or of a bare list: query, expected, key_facts, top_k."""
    boxed = spark.read.schema(f"questions array<{QUESTION}>, query string, expected string, key_facts array<string>, top_k int").json(path, multiLine=True)
    bare = F.array(F.struct("query", "expected", "key_facts", "top_k"))
    rows = boxed.select(F.explode(F.coalesce("questions", bare)).alias("q")).select("q.*").where("query IS NOT NULL")
    return rows.select("query", F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce("key_facts", F.array().cast("array<string>")).alias("key_facts"), "top_k")


def alias_seeds(spark: SparkSession, path: str | None = None) -> DataFrame:
    """surface and canonical of the built-in seeds; a JSON map in path adds to them and wins."""
    rows = spark.createDataFrame(list(ALIAS_SEEDS.items()), "surface string, canonical string")
    if path is None:
        return rows
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("surface", "canonical"))
    return stacked(rows.join(own, "surface", "left_anti"), own)
