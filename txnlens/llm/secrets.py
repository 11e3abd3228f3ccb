"""Secret scans with multipart credential linking, with DataFrame functions only.

Base spans are what three patterns find: assignments to a secret's name, access identifiers and long
hexadecimal runs. Linking adds weak candidates, which mean little alone: 40-character keys without a
name (with or without padding, also straight after "=") and endpoints (a URL of any scheme, or a host
name with a port, a path or three and more labels). A weak candidate is reported only when a
complementary part lies in the same scope: a key needs an access identifier, an endpoint needs an
access identifier or an assignment.

Scopes are intervals of the text. A text with section headers (``[name]`` alone on its line) is cut
before each header, any other text at its blank lines; a text with neither is one scope. Parts never
contain a line break, so each lies in one scope. Two interval joins on (row, cell of ``CELL`` code points)
do the rest: identifiers and assignments meet the scopes they lie in, and weak candidates meet the
scopes so found. Instead of the text's structure a number of code points can be given; then each
identifier or assignment opens a scope of its own that reaches that far to both sides.

Work and memory are proportional to a text's length: offsets are running sums over matches as rows, a
scope is kept once however many parts it has, and a cell holds a bounded number of scopes. Weak candidates
and scopes are looked for only in texts with an identifier or assignment.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; repeated rows
and rows without doc_id are documents of their own; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.tables import stage

# The base patterns. Groups are not captured except the value of an assignment.
ASSIGN = (
    r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# Weak candidates.
KEY = r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])(?:={1,2}(?![A-Za-z0-9/+=]))?"
ENDPOINT = (
    r"[A-Za-z][A-Za-z0-9+-]{1,15}://[A-Za-z0-9.:/_-]+"
    r"|(?<![A-Za-z0-9@._/-])(?:[A-Za-z0-9-]{1,63}\.){1,32}(?:[A-Za-z]{2,24}|[0-9]{1,3})(?::[0-9]{2,5}(?![0-9])|/)[A-Za-z0-9.:/_-]*"
    r"|(?<![A-Za-z0-9@._/-])(?:[A-Za-z0-9-]{1,63}\.){2,32}[A-Za-z]{2,24}(?![A-Za-z0-9_-])"
)
# Where scopes begin.
HEADER = r"(?<![^\n])\[[A-Za-z][A-Za-z0-9_.\"'\x20:/-]{0,199}\](?=[\x20\t\r]*(?![^\n]))"
BLANK = r"\n[\x20\t\r]*\n"

ASSIGN_CHARS, ACCESS_CHARS = 6, 20
SCOPE: int | None = None  # code points; None takes scopes from the text's structure
CELL = 1_024  # code points

KINDS = ["assign", "access", "hex", "key", "endpoint"]
BASE = KINDS[:3]
STRONG = [0, 1]
CUT = len(KINDS)  # the rank of scope boundaries among the marks

MARKS = "array<struct<gap:int,size:int,keep:boolean>>"


def found(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """The matches of a pattern, leftmost and without overlap, each with the length of the text before it.

    The text between matches and the matches themselves, put end to end, are the whole text; the last
    entry is the text after the last match, with no size. ``keep(match)`` is whether a match counts.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def mark(gap: Column, hit: Column) -> Column:
        counts = F.lit(True) if keep is None else keep(hit)
        return F.struct(
            F.length(gap).alias("gap"), F.length(hit).alias("size"), counts.alias("keep")
        )

    return F.zip_with(gaps, hits, mark).cast(MARKS)


def marked(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, marks by rank) of each document; one pass over the texts.

    ``row_id`` tells repeated rows apart; it holds from here on since the result is written.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= ASSIGN_CHARS
    long_id = lambda hit: F.length(hit) >= ACCESS_CHARS
    none = F.array().cast(MARKS)
    strong = text.rlike(ASSIGN) | text.rlike(ACCESS)
    cuts = F.when(text.rlike(HEADER), found(text, HEADER)).otherwise(found(text, BLANK))
    marks = [
        F.when(text.rlike(ASSIGN), found(text, ASSIGN, value)),
        F.when(text.rlike(ACCESS), found(text, ACCESS, long_id)),
        F.when(text.rlike(HEX), found(text, HEX)),
        F.when(strong, F.when(text.rlike(KEY), found(text, KEY))),
        F.when(strong, F.when(text.rlike(ENDPOINT), found(text, ENDPOINT))),
        F.when(strong, cuts),
    ]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.array(*[F.coalesce(m, none) for m in marks]).alias("marks"),
    )
    return stage(rows, "secret_marks")


def placed(rows: DataFrame, ranks: list[int]) -> DataFrame:
    """(row_id, rank, start, end, size, keep) of the marks of some ranks."""
    lists = rows.select("row_id", F.posexplode("marks").alias("rank", "list")).where(F.col("rank").isin(ranks))
    each = lists.select("row_id", "rank", F.posexplode("list").alias("i", "mark")).select(
        "row_id", "rank", "i", "mark.gap", F.coalesce("mark.size", F.lit(0)).alias("size"), "mark.keep"
    )
    so_far = Window.partitionBy("row_id", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    return each.withColumn("end", end).select(
        "row_id", "rank", (F.col("end") - F.col("size")).alias("start"), "end", "size", "keep"
    )


def parts(rows: DataFrame, ranks: list[int]) -> DataFrame:
    """(row_id, rank, start, end) of the spans of some ranks."""
    return placed(rows, ranks).where((F.col("size") > 0) & F.col("keep")).drop("size", "keep")


def scopes(rows: DataFrame) -> DataFrame:
    """(row_id, first, last) of the scopes of each text, as its first and last code point."""
    starts = placed(rows, [CUT]).select("row_id", "start")
    starts = starts.unionByName(starts.select("row_id", F.lit(0).alias("start")).distinct())
    after = F.lead("start").over(Window.partitionBy("row_id").orderBy("start"))
    return starts.select("row_id", F.col("start").alias("first"), (after - 1).alias("last")).where("first <= last")


def celled(spans: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each cell that a span touches; cells begin before the text for spans that do."""
    cell = lambda c: F.floor(c / CELL)
    return spans.withColumn("cell", F.explode(F.sequence(cell(first), cell(last))))


def opened(rows: DataFrame, scope: int | None) -> DataFrame:
    """(row_id, first, last, access) of the scopes that hold an identifier (``access``) or assignment."""
    strong = parts(rows, STRONG).withColumn("access", F.col("rank") == 1)
    if scope is not None:
        # spans within reach touch or overlap these
        reach = (F.col("start") - scope - 1).alias("first"), (F.col("end") + scope).alias("last")
        return strong.select("row_id", *reach, "access").distinct()
    here = strong.select("row_id", "start", "access", F.floor(F.col("start") / CELL).alias("cell"))
    within = celled(scopes(rows), F.col("first"), F.col("last"))
    return (
        here.join(within, ["row_id", "cell"])
        .where("start BETWEEN first AND last")
        .groupBy("row_id", "first", "last")
        .agg(F.max("access").alias("access"))
    )


def linked(rows: DataFrame, scope: int | None) -> DataFrame:
    """(row_id, rank, start, end) of weak candidates with a complementary part in scope."""
    weak = celled(parts(rows, [3, 4]), F.col("start"), F.col("end") - 1)
    open_ = celled(opened(rows, scope), F.col("first"), F.col("last"))
    return (
        weak.join(open_, ["row_id", "cell"])
        .where("start <= last AND end > first AND (access OR rank = 4)")
        .select("row_id", "rank", "start", "end")
        .distinct()
    )


def scan(docs: DataFrame, scope: int | None = SCOPE) -> DataFrame:
    """doc_id, base spans and all spans of each document as arrays of (start, rank, end)."""
    rows = marked(docs)
    spans = parts(rows, [0, 1, 2]).unionByName(linked(rows, scope))
    span = F.struct("start", "rank", "end")
    lists = spans.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") < len(BASE), span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.select("row_id", "doc_id").join(lists, "row_id", "left").select(
        "doc_id",
        F.coalesce("base", none).alias("base"),
        F.coalesce("spans", none).alias("spans"),
    )


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined with commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"]),
        ),
        ",",
    )
