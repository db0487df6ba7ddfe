"""Line deduplication by winnowing over line hashes.

A *gram* of a line is the run of lines from it that first reaches ``gram_words`` words; it is known
by the hash of its line hashes. Among the grams that begin within ``slack`` words the least hash is
selected (winnowing), so any repeated run of at least ``gram_words + slack - 1`` words (the *reach*)
holds a selected gram in all its places.

1. The places of equal selected grams are joined; documents without a gram of several places hold no
   repeated run of the reach and are done.
2. In the others the match is extended both ways: from each line the least run of the reach is taken
   onwards and backwards. Any run of the reach or more is covered by such runs inside it, and each of
   them has all the places that the run has.
3. Of the places of one run the first stays; the lines of the later ones are deleted.

No pairs of documents are drawn: a passage of a million places is one group that is summed before
the exchange. Only DataFrame and SQL functions are used. Lines travel as hashes and word counts; the
text moves once, when the deletions are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, private_names, tasks

GRAM_WORDS = 40
SLACK = 11


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def _line_hashes(text: Column) -> Column:
    """Per non-blank line: its number, the hash of its trimmed text, its words."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("t")))
    return F.transform(
        F.filter(lines, lambda x: x["t"] != ""),
        lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["t"]).alias("h"), F.size(F.split(x["t"], r"\s+")).alias("words")),
    )


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, lines): rows of the same id and text are one document."""
    text = _text(text_col)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("digest"), _line_hashes(text).alias("lines"))


def _grams(documents: DataFrame, gram_words: int, slack: int) -> DataFrame:
    """One row per non-blank line: (id, digest, line, chosen, chosen_line, ahead, ahead_line, behind, behind_line).

    ``chosen`` is the gram that the line's window selects, ``chosen_line`` where it begins; ``ahead`` and ``behind`` are the hashes of
    the least runs of the reach that begin and end here, with the number of their other end's line,
    null where the document has no such run.
    """
    reach = gram_words + slack - 1
    rows = documents.select("id", "digest", F.posexplode_outer("lines").alias("pos", "l"))
    rows = rows.select("id", "digest", "pos", "l.line", "l.h", "l.words").filter("pos is not null")
    # one row of each line where a document is repeated; the windows below use the same exchange. Line hashes are small when
    # exchanged and large when sorted, so the number of tasks is given and not made from the exchanged bytes
    lines = rows.repartition(tasks(documents.sparkSession), "id", "digest").groupBy("id", "digest", "pos").agg(*(F.first(c).alias(c) for c in ("line", "h", "words")))
    doc = Window.partitionBy("id", "digest")
    upto = F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = lines.withColumn("upto", upto).withColumn("at", F.col("upto") - F.col("words"))

    def run(name: str, over) -> dict[str, Column]:
        return {f"{name}_words": F.sum("words").over(over), f"{name}_hash": F.xxhash64(F.collect_list("h").over(over))}

    onwards = doc.orderBy("at").rangeBetween(0, reach - 1)
    back = doc.orderBy("upto").rangeBetween(1 - reach, 0)
    spans = placed.withColumns(run("gram", doc.orderBy("at").rangeBetween(0, gram_words - 1)) | run("ahead", onwards))
    spans = spans.withColumn("ahead_line", F.max("line").over(onwards)).withColumns(run("behind", back)).withColumn("behind_line", F.min("line").over(back))
    full = F.when(F.col("gram_words") >= gram_words, F.struct("gram_hash", (-F.col("line")).alias("back")))
    spans = spans.withColumn("least", F.min(full).over(doc.orderBy("at").rangeBetween(0, slack - 1)))
    return spans.select(
        "id",
        "digest",
        "line",
        F.col("least.gram_hash").alias("chosen"),
        (-F.col("least.back")).alias("chosen_line"),
        *(F.when(F.col(f"{n}_words") >= reach, F.col(c)).alias(a) for n in ("ahead", "behind") for c, a in ((f"{n}_hash", n), (f"{n}_line", f"{n}_line"))),
    )


def repeated_runs(
    docs: DataFrame, gram_words: int = GRAM_WORDS, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, digest, spans): per document the spans (first, last) of line numbers that repeat an earlier place.

    Spans are disjoint and in order; documents without any are left out.
    """
    grams = checkpointed(_grams(_documents(docs, id_col, text_col), gram_words, slack))
    place = F.struct("id", "digest", "chosen_line")
    chosen = grams.filter("chosen is not null").groupBy("chosen").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("chosen")
    met = grams.select("id", "digest", "chosen").join(chosen, "chosen", "left_semi").select("id", "digest").distinct()
    same = F.col("g.id").eqNullSafe(F.col("m.id")) & (F.col("g.digest") == F.col("m.digest"))
    candidates = grams.alias("g").join(met.alias("m"), same, "left_semi")
    ends = [("ahead", "line", "ahead_line"), ("behind", "behind_line", "line")]
    runs = candidates.select("id", "digest", F.inline(F.array(*(F.struct(F.col(k).alias("run"), F.col(a).alias("start"), F.col(b).alias("stop")) for k, a, b in ends))))
    runs = checkpointed(runs.filter("run is not null"))
    begin = F.struct("id", "digest", "start")
    firsts = runs.groupBy("run").agg(F.min(begin).alias("first"), F.max(begin).alias("last")).filter("first <> last").select("run", "first")
    later = runs.join(firsts, "run").filter(begin != F.col("first")).select("id", "digest", "start", "stop").distinct()
    # overlapping and touching spans of one document become one
    order = Window.partitionBy("id", "digest").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = islands.groupBy("id", "digest", "island").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    return whole.groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def drop_repeated_lines(
    docs: DataFrame, gram_words: int = GRAM_WORDS, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None
) -> DataFrame:
    """``docs`` with the later places of repeated line runs deleted from ``text_col``.

    A line goes exactly if it stands in a run of at least ``gram_words + slack - 1`` words that has an
    earlier place. Lines are compared by their trimmed text; blank lines belong to no run and stay.
    The first place, by (id, text hash, line), stays; a null id comes first. Within a document a later
    repeat of its own lines goes too. All rows and columns stay, whatever their names; null texts stay
    null, a text may become empty, an empty table stays empty; rows of the same id and text are one
    document, so that copies of it change alike. With ``removed_col`` the number of deleted lines is
    added (or replaces the column of that name).
    """
    own_id, own_digest, own_spans = private_names(docs, "id", "digest", "spans")
    runs = checkpointed(repeated_runs(docs, gram_words, slack, id_col, text_col))
    runs = runs.select(F.col("id").alias(own_id), F.col("digest").alias(own_digest), F.col("spans").alias(own_spans))
    joined = docs.join(runs, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(_text(text_col)) == F.col(own_digest)), "left")
    # whether each line is in a span, as one array: the work is linear in the text
    gap = f"transform({own_spans}, (s, k) -> concat(array_repeat(false, int(s.first - IF(k = 0, 0, get({own_spans}, k - 1).last + 1))), array_repeat(true, int(s.last - s.first + 1))))"
    blank = r"regexp_replace(x, '^\\s+|\\s+$', '') = ''"
    lines = f"filter(split(`{text_col}`, '\\n'), (x, i) -> NOT coalesce(get(m, i), false) OR {blank})"
    kept = F.expr(f"element_at(transform(array(flatten({gap})), m -> array_join({lines}, '\\n')), 1)")
    edited = F.when(F.col(own_spans).isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    names = [c for c in docs.columns if c != removed_col]
    if not removed_col:
        return joined.select(*(edited.alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
    taken = F.expr(f"size(filter(element_at(transform(array(flatten({gap})), m -> transform(split(`{text_col}`, '\\n'), (x, i) -> coalesce(get(m, i), false) AND NOT ({blank}))), 1), v -> v))")
    removed = F.when(F.col(own_spans).isNull(), 0).otherwise(taken).cast("long")
    return joined.select(*(edited.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), removed.alias(removed_col))
