"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import parts, text_or_empty

#: Low bits of a key hold the place in the text, reversed: of equal hashes the rightmost is least. High bits hold the
#: hash. A string has fewer than 2^31 bytes, so no place wraps.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1


def _let(value: str, name: str, body: str) -> str:
    """body with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _selected(text: str, k: int, window: int, offset: str, part: int) -> str:
    """The selected keys of a text, by parts of so many windows; a part's grams are all that is held at once."""
    if window & (window - 1):
        raise ValueError("window has to be a power of two")
    grams = _let(
        f"substring({text}, at + 1, {part + window + k - 2})", "own",
        f"CASE WHEN length(own) < {k} THEN array(own) ELSE regexp_extract_all(own, '(?s)(?=(.{{{k}}})).', 1) END",
    )
    keys = f"transform({grams}, (x, i) -> (xxhash64(x) & {~PLACE}L) | ({PLACE}L - ({offset} + at + i)))"
    reach = 1
    while reach < window:  # the windows' minima by doubling: over 1, 2, 4, ... neighbours; past the end there is none
        w = f"w{reach}"
        keys = _let(keys, w, f"zip_with({w}, slice({w}, {reach + 1}, greatest(size({w}) - {reach}, 0)), (x, y) -> least(x, y))")
        reach *= 2
    kept = _let(keys, "w", f"array_distinct(slice(w, 1, greatest(size(w) - {window - 1}, 1)))")
    starts = f"sequence(0, greatest(length({text}) - {k + window - 1}, 0), {part})"
    return f"CASE WHEN {text} = '' THEN cast(array() AS array<bigint>) ELSE array_distinct(flatten(transform({starts}, at -> {kept}))) END"


def winnow(df: DataFrame, text: str, out: str, k: int = 8, window: int = 16, offset: str = "0", part: int = 65_536) -> DataFrame:
    """df with out: the selected keys of column text, an array of longs in order of place.

    A key joins the high bits of the XXH64 of a k-gram of code points with its place (from offset on).
    Every window of so many k-grams in a row selects its least hash, the rightmost of equals; so two
    texts with an equal passage of window + k - 1 code points share a selected hash. A text of fewer
    than window k-grams is one window, one shorter than k is one gram, an empty one selects nothing.
    Null texts have null keys; texts of any length are taken by parts.
    """
    return df.select(*[c for c in df.columns if c != out], F.expr(_selected(text, k, window, offset, part)).alias(out))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, window: int = 16) -> DataFrame:
    """(doc_id, marks): an array of (place, hash) of each row's selected k-grams, in order of place; null texts are empty.

    Texts that share a passage of window + k - 1 code points have a common hash whose places lie in it.
    """
    rows = winnow(df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t")), "_t", "_k", k, window)
    return rows.select("doc_id", F.expr(f"transform(_k, x -> struct(cast({place('x')} AS int) AS place, shiftright(x, {PLACE_BITS}) AS hash))").alias("marks"))


def place(key: str) -> str:
    return f"({PLACE}L - ({key} & {PLACE}L))"


def hashes(keys: str) -> Column:
    """The distinct hashes of selected keys, 32 bits of each."""
    return F.expr(f"array_distinct(transform({keys}, x -> cast(shiftright(x, 32) AS int)))")


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 if neither has any."""
    return F.expr(f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) AS double) END")


def digest(keys: str) -> Column:
    """16 hex digits over all selected keys with their places."""
    return F.lower(F.lpad(F.hex(F.xxhash64(keys)), 16, "0"))


def cells(df: DataFrame, rows_each: int = 64, bins: int = 64, most: int = 512) -> Column:
    """A number that grows with (doc_id, tag) of df, nulls first, for ranges of about rows_each rows; tag is a hash.

    Ranges of ids are cut evenly. A range whose histogram is uneven is parted where it is crowded, between the
    least and largest ids there are, so single far ids don't matter. Ids of more than a thousandth of all rows,
    which are a thousand at most, and null ids are cut by the tag. The driver sees bins and these ids only.
    """
    total, nulls, low, high = df.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    hot = df.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > rows_each) & (F.col("n") * 1000 > total)).collect() if total else []
    of_hot = {r["doc_id"]: r["n"] for r in hot}
    plain = df.where(F.col("doc_id").isNotNull() & (~F.col("doc_id").isin(list(of_hot)) if of_hot else F.lit(True)))
    todo, done = ([(low, high)] if low is not None else []), []
    while todo:
        starts = F.array(*[F.lit(a).cast("long") for a, _ in todo])
        at = F.size(F.filter(starts, lambda s: s <= F.col("doc_id"))) - 1
        lo, hi = (F.element_at(F.array(*[F.lit(float(x[k])) for x in todo]), F.col("at") + 1) for k in (0, 1))
        share = F.least(F.floor((F.col("doc_id").cast("double") - lo) / (hi - lo + 1) * bins), F.lit(bins - 1)).cast("int")
        here = plain.withColumn("at", at).where("at >= 0").where(F.col("doc_id") <= F.element_at(F.array(*[F.lit(b).cast("long") for _, b in todo]), F.col("at") + 1))
        found: dict[int, list] = {}
        for r in here.groupBy("at", share.alias("bin")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("at", "bin").collect():
            found.setdefault(r["at"], []).append((r["n"], r["low"], r["high"]))
        again = []
        for k, own in found.items():
            n = sum(x[0] for x in own)
            limit = max(4 * rows_each, 8 * n // bins)
            if max(x[0] for x in own) <= limit or own[0][1] == own[-1][2] or len(done) + len(again) >= most:
                done.append((own[0][1], own[-1][2], n))
                continue
            run: list = []
            for x in [*own, None]:  # crowded bins by themselves, what lies between them together
                if x is None or x[0] > limit:
                    if run:
                        done.append((run[0][1], run[-1][2], sum(y[0] for y in run)))
                    run = []
                    if x is not None:
                        again.append((x[1], x[2]))
                else:
                    run.append(x)
        todo = again
    ranges = []  # (first id, last id, cuts, whether by the tag), in order
    for a, b, n in done:
        for h in sorted(h for h in of_hot if a < h < b):  # a hot id parts the range around it
            ranges.append((a, h - 1, math.ceil(n * (h - a) / (b - a + 1) / rows_each), False))
            n, a = math.ceil(n * (b - h) / (b - a + 1)), h + 1
        ranges.append((a, b, math.ceil(n / rows_each), False))
    ranges = sorted([*ranges, *((h, h, math.ceil(n / rows_each), True) for h, n in of_hot.items())])
    of_nulls = math.ceil(nulls / rows_each) if nulls else 0
    first, seen = [], of_nulls
    for r in ranges:
        first.append(seen)
        seen += max(1, r[2])
    by_tag = (F.col("tag").cast("double") / 2.0**64 + 0.5) if of_hot or nulls else F.lit(0.0)
    if not ranges:
        return F.floor(by_tag * max(1, of_nulls)).cast("long")
    at = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(r[0]).cast("long") for r in ranges]), lambda s: s <= F.col("doc_id")))) if len(ranges) > 1 else F.lit(1)
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at) if len(values) > 1 else F.lit(values[0]).cast(kind)
    into = (F.col("doc_id").cast("double") - pick([r[0] for r in ranges], "double")) / pick([float(r[1]) - float(r[0]) + 1 for r in ranges], "double")
    if of_hot:
        into = F.when(pick([r[3] for r in ranges], "boolean"), by_tag).otherwise(into)
    cuts = pick([max(1, r[2]) for r in ranges], "long")
    cell = pick(first, "long") + F.greatest(F.lit(0).cast("long"), F.least(F.floor(into * cuts).cast("long"), cuts - 1))
    if not nulls:
        return cell
    return F.when(F.col("doc_id").isNull(), F.least(F.floor(by_tag * of_nulls).cast("long"), F.lit(of_nulls - 1).cast("long"))).otherwise(cell)


def following(numbers: DataFrame, width: int = 1024, at_once: int = 10_000) -> DataFrame:
    """(cell, after): the next larger number of distinct numbers (column cell), null after the last.

    Beyond at_once numbers, they are ordered within ranges of width, and the ranges in turn likewise.
    """
    if numbers.count() <= at_once:
        return numbers.select("cell", F.lead("cell").over(Window.orderBy("cell")).alias("after"))
    ranged = numbers.withColumn("range", F.floor(F.col("cell") / width))
    ranges = ranged.groupBy("range").agg(F.min("cell").alias("least"))
    order = following(ranges.select(F.col("range").alias("cell")), width, at_once).select(F.col("cell").alias("range"), F.col("after").alias("next_range"))
    heads = order.join(ranges.select(F.col("range").alias("next_range"), "least"), "next_range", "left").select("range", "least")
    within = F.lead("cell").over(Window.partitionBy("range").orderBy("cell"))
    return ranged.withColumn("within", within).join(heads, "range", "left").select("cell", F.coalesce("within", "least").alias("after"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, window: int = 16) -> DataFrame:
    """(doc_id, text, keys, next_text, next_hashes): each row's selected keys and those of the next row by ascending id.

    Null texts are empty; rows without an id come first, rows of one id are ordered by the XXH64 of their texts;
    the first row follows the last. Texts are shuffled once, to cells of neighbouring ids. Within a cell the next
    row is a window's lead; the first row of each cell also goes to the cell before it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    ids = rows.select("doc_id", "tag")
    cell = F.coalesce(cells(ids), F.lit(0).cast("long"))  # never null, so no join adds a filter below the exchange
    firsts = ids.withColumn("cell", cell).groupBy("cell").agg(F.count("*").alias("n"))
    n = parts(spark, firsts.agg(F.sum("n")).first()[0] or 0, 2048)
    base = rows.withColumn("cell", cell).repartition(n, "cell")
    after = following(firsts.select("cell"))
    lowest = firsts.agg(F.min("cell")).first()[0]
    before = after.select(F.col("cell").alias("to_cell"), F.coalesce("after", F.lit(lowest)).alias("cell"))
    order = Window.partitionBy("cell").orderBy("doc_id", "tag", "text")
    heads = (
        base.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("cell", "text")
        .join(before, "cell").select(F.col("to_cell").alias("cell"), F.col("text").alias("head_text"))
    )
    heads = winnow(heads, "head_text", "head_keys", k, window).select("cell", "head_text", hashes("head_keys").alias("head_hashes")).repartition(n, "cell")
    own = winnow(base, "text", "keys", k, window).select("*", hashes("keys").alias("own_hashes"))
    led = own.select("cell", "doc_id", "text", "keys", F.lead("text").over(order).alias("lead_text"), F.lead("own_hashes").over(order).alias("lead_hashes"))
    return led.join(heads, "cell").select("doc_id", "text", "keys", F.coalesce("lead_text", "head_text").alias("next_text"), F.when(F.col("lead_text").isNull(), F.col("head_hashes")).otherwise(F.col("lead_hashes")).alias("next_hashes"))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, window: int = 16) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text's keys before its last intact windows are the text's own; only the windows from
    there on are hashed again.
    """
    span = window - 1
    rows = with_next(df, id_col, text_col, k, window)
    rows = rows.select("*", F.length("text").cast("long").alias("n_chars"))
    rows = rows.select("*", F.expr("n_chars - floor(n_chars / 4)").alias("keep"))
    rows = rows.select("doc_id", "n_chars", "keys", "next_hashes", F.expr("concat(substring(text, 1, cast(keep AS int)), substring(next_text, 1, cast(n_chars - keep AS int)))").alias("edited"), F.expr(f"cast(greatest(keep - {k - 1} - {2 * span}, 0) AS int)").alias("same"))
    rows = rows.select("doc_id", "n_chars", "keys", "next_hashes", "same", F.sha2("edited", 256).alias("edited_sha256"), F.expr(f"greatest(same - {span}, 0)").alias("back"), "edited")
    rows = rows.select("doc_id", "n_chars", "keys", "next_hashes", "same", "edited_sha256", "back", F.expr("substring(edited, back + 1)").alias("tail"))
    rows = winnow(rows, "tail", "tail_keys", k, window, "back")
    edited = f"concat(filter(keys, x -> {place('x')} < same), filter(tail_keys, x -> {place('x')} >= same))"
    rows = rows.select("doc_id", "n_chars", "keys", "next_hashes", "edited_sha256", F.expr(edited).alias("edited_keys"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", digest("keys").alias("fingerprint"), digest("edited_keys").alias("edited_fingerprint"), hashes("keys").alias("own"), hashes("edited_keys").alias("other"), "next_hashes")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("own", "other").alias("near_edited"), likeness("own", "next_hashes").alias("near_next"))
