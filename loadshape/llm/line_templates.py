"""Line dedup by a tree of log templates (built-in functions only).

A line is cut into tokens. The tree has a fixed depth: the number of tokens,
then the first ``DEPTH`` tokens, with tokens that hold a digit read as a
variable field. A leaf gathers the lines that agree on these; its template
keeps the token of a place where more than ``AGREE`` percent of its distinct
lines have it, and a variable field elsewhere, so fields that vary without
digits are generalised too. A line follows the template if at least ``SIMILAR``
percent of all its tokens and ``AGREE`` percent of those behind the leading ones
are the template's.

A leaf has as many templates as it needs: lines that do not follow its first one
are split by the token (in the next rounds the two, four, eight ... tokens) that
most of the remaining lines have in the same place, and each part votes again.
A line that follows no template of several lines is a template of its own, so
a line that recurs as it stands is always found; lines with one token behind the
leading ones need to be equal.

Templates met in ``MIN_DOCS`` or more documents are recurring. Of all lines
that follow one, the first (smallest id, then first in the text) stays and the
others are dropped. Lines of fewer than ``MIN_TOKENS`` tokens carry too little
to be templates and stay, as do lines without a token.

Only the lines of leaves that several documents meet are looked into token by
token; equal lines are combined before that.

Defined cases: a null text equals the empty one and keeps its one empty line;
null ids are documents of their own text, ordered first; rows that repeat an id
and text are one document in counts and get equal results; an empty table
gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, broadcast_up_to, stash, table, two_columns

DEPTH = 3
AGREE = 50
SIMILAR = 60
MIN_DOCS = 3
MIN_TOKENS = 4
LEAVES_BROADCAST = 2_000_000


def _tokens(line):
    plain = F.split(line, " ")          # a split at one character needs no pattern matching
    return F.filter(F.when(line.rlike("[\t\x0b-\r]"), F.split(line, WORD_SPLIT)).otherwise(plain), lambda x: x != "")


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, at, line): every line with its number; ``doc`` tells
    documents apart that share an id or have none."""
    docs = two_columns(df, id_col, text_col).withColumn("doc", F.xxhash64("doc_id", "text"))
    return docs.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def leaf_of(tokens):
    """The leaf of a line's tokens: their number and the leading ones, variable
    fields masked; null for lines that are too short."""
    lead = F.transform(F.slice(tokens, 1, DEPTH), lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.when(F.size(tokens) >= MIN_TOKENS, F.xxhash64(F.size(tokens), lead))


def _masked(t):
    return F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t)


def _split(rest: DataFrame, n_tokens: int) -> DataFrame:
    """``rest`` with its parts split by the ``n_tokens`` tokens of each line
    that most lines of its part share. Left out are lines that share too few to
    follow any template, and those whose last part knew all that they share."""
    shared = Window.partitionBy("part", "place", "token")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "place", "token")))
    enough = (100 * F.size("ranked") >= AGREE * F.col("size")) & (2 * F.size("ranked") > F.lit(n_tokens if n_tokens > 1 else 0))
    child = (rest.select("leaf", "part", "line_hash", F.size("tail").alias("size"), F.posexplode("tail").alias("place", "token"))
             .withColumn("n", F.count("*").over(shared)).where("n > 1")
             .groupBy("leaf", "part", "line_hash", "size").agg(ranked.alias("ranked")).where(enough)
             .withColumn("best", F.slice("ranked", 1, n_tokens))
             .select("leaf", "line_hash", F.xxhash64("part", F.sort_array(F.transform("best", lambda x: F.struct(x["place"], x["token"])))).alias("part")))
    return rest.drop("part").join(child, ["leaf", "line_hash"])


def templates(lines: DataFrame) -> DataFrame:
    """(leaf, line_hash, template) of the distinct lines in leaves met by more
    than one document; the template is a number."""
    busy = stash(lines.groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("leaf"), "leaves")
    some = lines.join(broadcast_up_to(busy, LEAVES_BROADCAST), "leaf", "left_semi").select("leaf", "line_hash", "line").distinct()
    some = stash(some, "leaf-lines")
    sizes = some.groupBy("leaf").agg(F.count("*").alias("n_lines"))
    # the leaf fixes the leading tokens
    tail = F.transform(F.slice(_tokens(F.col("line")), DEPTH + 1, 1 << 30), _masked)
    some = stash(some.join(sizes, "leaf").withColumn("tail", tail).drop("line"), "leaf-tokens")
    own = some.select("leaf", "line_hash", F.xxhash64("leaf", "tail").alias("template"))
    rest = some.where("n_lines > 1").select("leaf", "line_hash", "tail", F.col("leaf").alias("part"))
    follows, n_tokens = None, 1
    while True:
        votes = (rest.select("part", F.posexplode("tail").alias("place", "token"))
                 .groupBy("part", "place", "token").agg(F.count("*").alias("n"))
                 .groupBy("part", "place").agg(F.max(F.struct("n", "token")).alias("best"), F.sum("n").alias("n_lines"))
                 .where((F.col("n_lines") > 1) & (100 * F.col("best.n") > AGREE * F.col("n_lines")))
                 .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("best.token")))).alias("fixed")))
        hits = F.size(F.filter("tail", lambda t, k: F.coalesce(t == F.col("fixed")[k], F.lit(False))))
        size = F.size("tail")
        close = (100 * (hits + DEPTH) >= SIMILAR * (size + DEPTH)) & (100 * hits >= AGREE * size)
        judged = rest.join(votes, "part", "left").select(
            "leaf", "line_hash", "tail", "part", F.when(F.col("fixed").isNotNull() & close, F.xxhash64(
                "leaf", F.transform("tail", lambda t, k: F.coalesce(F.col("fixed")[k], F.lit("<*>"))))).alias("template"))
        judged = stash(judged, "leaf-votes")
        found = judged.where("template is not null").select("leaf", "line_hash", "template")
        follows = found if follows is None else follows.unionByName(found)
        rest = stash(_split(judged.where("template is null").drop("template"), n_tokens), "leaf-parts")
        if not rest.limit(1).count():
            break
        n_tokens *= 2
    own = own.join(follows.withColumnRenamed("template", "followed"), ["leaf", "line_hash"], "left")
    return stash(own.select("leaf", "line_hash", F.coalesce("followed", "template").alias("template")), "templates")


def drop_templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input document: doc_id, n_lines, n_dropped, the kept text
    and the dropped lines' numbers."""
    # every line is cut into tokens once; its text is read back for busy leaves only
    lines = lines_of(df, id_col, text_col).withColumn("tokens", _tokens(F.col("line")))
    lines = stash(lines.withColumn("leaf", leaf_of(F.col("tokens"))).where("leaf is not null")
                  .select("doc_id", "doc", "at", "leaf", F.xxhash64("line").alias("line_hash"), "line"), "lines")
    follows = templates(lines).toDF("_leaf", "_line", "template")
    met = lines.join(broadcast_up_to(follows, LEAVES_BROADCAST), (F.col("leaf") == F.col("_leaf")) & (F.col("line_hash") == F.col("_line")))
    met = stash(met.select("doc_id", "doc", "at", "template"), "template-lines")
    place = F.struct(F.col("doc_id"), "doc", "at")
    recurring = (met.groupBy("template", "doc").agg(F.min(place).alias("first"))
                 .groupBy("template").agg(F.count("*").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= MIN_DOCS))
    gone = (met.join(recurring, "template").where(place != F.col("first"))
            .groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("dropped")))
    docs = two_columns(df, id_col, text_col).withColumn("doc", F.xxhash64("doc_id", "text"))
    out = docs.join(gone, "doc", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains("dropped", k))
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                      F.size("dropped").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"), "dropped")


def op3_line_templates(spark, sf_dir: str) -> DataFrame:
    return drop_templates(table(spark, sf_dir, "documents")).drop("dropped")
