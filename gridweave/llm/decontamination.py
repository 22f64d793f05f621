"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, which a scan of all document windows probes.

A document is cut into words; every window becomes a row of a stream that carries the hash of its first, middle and
last word, and probes the broadcast table of the benchmark's hashes. No window is shuffled: what the set lets through is
verified by joining the window's words themselves. Of a benchmark with more hashes than one broadcast may hold, the set
is a bit filter of bounded size, three bits a hash; it lets a few windows more through, which the words sort out. The
documents are scanned once whatever the benchmark's size.

Items are kept apart from windows: windows that occur in the same items share the number of that set of items, so a hit
carries two numbers, whatever the number of items that hold it.

Defined cases: null or wordless texts have no words and no hits; a benchmark item with fewer words than the window is
one window of its own length; wordless items match nothing; rows of equal doc_id and text are judged once and each
reported; repeated items count each by its item_id; empty tables give an empty report, or one without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, TEXT_KEY, checkpoint, join_rows, sized_text, with_text_key

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bits of the filter for a hash, at most so many in all (64 MB), and those that a row of the filter holds.
HASH_BITS, FILTER_BITS, ROW_BITS = 16, 1 << 29, 1 << 15


def words(text: str = "text") -> Column:
    return F.expr(f"array_remove(split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{GAP}'), '')")


def _probe() -> Column:
    """Hash of the length and the first, middle and last word of the window of `len` words from `pos`, counted from 1."""
    return F.expr("xxhash64(len, w[pos - 1], w[pos - 1 + len DIV 2], w[pos + len - 2])")


def _window() -> Column:
    return F.expr("array_join(slice(w, pos, len), ' ')")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(probe, len, win, items_key), each window once, and (items_key, items), the sets of items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).filter("size(w) > 0")
    items = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = items.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("pos"))
    held = starts.select("item_id", "len", _probe().alias("probe"), _window().alias("win"))
    named = held.groupBy("probe", "len", "win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    named = checkpoint(named.withColumn("items_key", F.sha2(F.to_json("items"), 256)))
    return named.drop("items"), checkpoint(named.groupBy("items_key").agg(F.first("items").alias("items")))


def _starts(lengths: list[int]) -> Column:
    """The array of (pos, len) codes of a document's windows, pos * lengths + place of the length; 0 stands for the document itself."""
    return F.sequence(F.lit(0), F.greatest(F.size("w") * len(lengths) + len(lengths) - 1, F.lit(0)))


def _marks(buckets: int) -> tuple[Column, Column]:
    """Row of the filter for a probe, and its three places there."""
    mixed = F.xxhash64("probe")
    return F.shiftrightunsigned(mixed, 45) % buckets, F.array(*(F.shiftrightunsigned(mixed, s).bitwiseAND(ROW_BITS - 1).cast("int") for s in (0, 15, 30)))


def hash_filter(probes: DataFrame, hashes: int) -> tuple[DataFrame, int]:
    """(bucket, bits: array of longs) that marks each of the distinct probes, a row for every bucket, and their number."""
    buckets = max(1, min(FILTER_BITS, 1 << (hashes * HASH_BITS - 1).bit_length()) // ROW_BITS)
    bucket, places = _marks(buckets)
    marks = probes.select(bucket.alias("bucket"), F.explode(places).alias("place"))
    words = marks.groupBy("bucket", F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, place & 63))").alias("bits"))
    per_row = ROW_BITS // 64
    slots = probes.sparkSession.range(buckets * per_row).select(F.shiftright("id", per_row.bit_length() - 1).alias("bucket"), (F.col("id") % per_row).cast("int").alias("word"))
    held = slots.join(words, ["bucket", "word"], "left").select("bucket", F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("held"))
    return checkpoint(held.groupBy("bucket").agg(F.sort_array(F.collect_list("held"))["bits"].alias("bits"))), buckets


def _let_through(rows: DataFrame, probes: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of pos 0, and those whose probe is in the set, or is let through by its filter."""
    hashes = probes.count()
    document = F.col("pos") == 0
    if hashes <= broadcast_rows:
        known = probes.unionByName(probes.sparkSession.range(1).select(F.lit(0).cast("long").alias("probe"))).distinct()
        return rows.withColumn("probe", F.when(document, F.lit(0).cast("long")).otherwise(F.col("probe"))).join(F.broadcast(known), "probe")
    bits, buckets = hash_filter(probes, hashes)
    bucket, places = _marks(buckets)
    marked = rows.select("*", F.when(document, F.lit(0).cast("long")).otherwise(bucket).alias("bucket"), places.alias("places"))
    held = F.expr(" AND ".join(f"getbit(bits[shiftright(places[{i}], 6)], places[{i}] & 63) = 1" for i in range(3)))
    named = bits.withColumnRenamed("bucket", "__bucket")
    return marked.join(F.broadcast(named), (F.col("bucket") == F.col("__bucket")) & (document | held))  # FILTER_BITS at most


def window_hits(docs: DataFrame, windows: DataFrame, carry: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(carry, n_words, pos, len, items_key): one row with pos 0 per document row, and one per verified window."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most `window` of them
    cut = docs.select(*carry, words().alias("w"))
    if not lengths:
        return cut.select(*carry, F.size("w").cast("long").alias("n_words"), F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("items_key"))
    place = F.get(F.array(*map(F.lit, lengths)), F.col("at") % len(lengths))
    rows = cut.select("*", F.explode(_starts(lengths)).alias("at"))
    rows = rows.select(*carry, "w", (F.col("at") / len(lengths)).cast("int").alias("pos"), place.alias("len")).filter("pos > 0 AND pos + len <= size(w) + 1 OR pos = 0 AND len = %d" % lengths[0])
    found = _let_through(rows.withColumn("probe", F.when(F.col("pos") > 0, _probe())), windows.select("probe").distinct(), broadcast_rows)
    # A document's own row joins nothing; where the join shuffles, a hash in place of words spreads such rows.
    shown = F.when(F.col("pos") > 0, _window()).otherwise(F.hex(F.xxhash64(*carry)))
    found = found.select(*carry, F.size("w").cast("long").alias("n_words"), "pos", F.when(F.col("pos") > 0, F.col("len")).otherwise(0).alias("len"), shown.alias("win"))
    # The words themselves are compared here, so a hash that agrees by chance drops out.
    known = sized_text(windows.select(F.col("win").alias("__win"), F.col("len").alias("__len"), "items_key"), "__win")
    verified = found.join(known, (F.col("win") == F.col("__win")) & (F.col("len") == F.col("__len")), "left")
    return verified.filter("pos = 0 OR items_key IS NOT NULL").select(*carry, "n_words", "pos", "len", "items_key")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs`: doc_id, the columns `carry`, n_words, spans hit as array of (pos, end), item_ids, n_hit, contaminated."""
    windows, item_sets = benchmark_windows(benchmark, window)
    key = ["doc_id", *TEXT_KEY]
    hits = window_hits(with_text_key(docs.select("doc_id", "text")), windows, key, broadcast_rows)
    span = F.when(F.col("pos") > 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))
    rows = hits.groupBy(*key, "n_words").agg(F.count_if(F.col("pos") == 0).cast("int").alias("rows"), F.collect_set(span).alias("spans"), F.collect_set("items_key").alias("sets"))
    rows = checkpoint(rows)
    touched = rows.filter("size(sets) > 0").select(*key, F.explode("sets").alias("items_key")).join(sized_sets(item_sets), "items_key")
    ids = touched.select(*key, F.explode("items").alias("item_id")).groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    clean = rows.filter("size(sets) = 0").withColumn("item_ids", F.expr("CAST(array() AS array<string>)"))
    report = clean.unionByName(join_rows(rows.filter("size(sets) > 0"), ids, "inner").select(*clean.columns))
    covered = "aggregate(sort_array(spans), named_struct('to', 0, 'n', 0L), (a, s) -> named_struct('to', greatest(a.to, s.end), 'n', a.n + greatest(0, s.end - greatest(a.to, s.pos))), a -> a.n)"
    fields = ["doc_id", *carry]
    report = report.select(*fields, "n_words", F.sort_array("spans").alias("spans"), "item_ids", F.expr(covered).alias("n_hit"), F.explode(F.array_repeat(F.lit(True), F.col("rows"))).alias("__row"))
    return report.drop("__row").withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def sized_sets(item_sets: DataFrame) -> DataFrame:
    """Broadcast while all sets together hold few enough items."""
    total = item_sets.agg(F.coalesce(F.sum(F.size("items").cast("long") + 8), F.lit(0))).first()[0]
    return F.broadcast(item_sets) if total <= BROADCAST_ROWS else item_sets


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that the report doesn't call contaminated, all columns; rows that share a doc_id are told apart by text."""
    docs = with_text_key(docs)
    bad = contamination(docs.drop(*TEXT_KEY), benchmark, carry=TEXT_KEY).filter("contaminated").select("doc_id", *TEXT_KEY).distinct()
    return join_rows(docs, bad, "left_anti").drop(*TEXT_KEY)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text): the normalised words of each document without those that a benchmark window covers."""
    docs = with_text_key(docs.select("doc_id", "text"))
    # Rows alike in id and text have the same spans.
    spans = contamination(docs.drop(*TEXT_KEY), benchmark, carry=TEXT_KEY).filter("n_hit > 0").groupBy("doc_id", *TEXT_KEY).agg(F.first("spans").alias("spans"))
    cut = join_rows(docs.select("doc_id", *TEXT_KEY, "text", words().alias("w")), spans, "left")
    left = F.expr("array_join(filter(w, (x, i) -> NOT exists(spans, s -> i + 1 >= s.pos AND i + 1 < s.end)), ' ')")
    return cut.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left).alias("text"))
