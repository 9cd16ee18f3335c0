"""Line dedup (operator 6): exact set-similarity join of lines, native.

A line's tokens are its distinct lower-cased words between white space. Lines with the same tokens are one class (its
key: two 64-bit hashes of the tokens). A class comes first where its first line does, by (doc_id, row key, line
number). A line is removed if it is not the first of its class, or if an earlier class has a Jaccard similarity of 4/5
or more with its own.

Token order: a token is its 64-bit hash, whose leading bits give way to the level (a logarithm) of its bucket's count
in the corpus, so ascending numbers run from rare to frequent (any fixed order gives the same pairs; this one keeps
lists short). Similar sets share a token of their prefixes of n - ceil(0.8 n) + 1 tokens, and of the shorter set even
of n - ceil(8 n / 9) + 1; of candidates by a shared prefix token, those stay whose sizes and positions still allow the
overlap, and whose parity bitmaps (a token flips one bit) differ in no more bits than their sets may differ in tokens;
their whole sets of words are then compared.

What the result needs is one earlier partner of a class, not all of them, so a class that has one is decided and is
not asked again (it stays a partner for later ones). First each class meets its leaders only, the earliest classes
under its ROUND_TOKENS rarest tokens; that decides nearly all of a group of near copies, in proportion to its size.
Then the undecided classes meet all earlier ones.

A token in more than HOT prefixes is no key by itself: similar sets also share a second token of the prefix that is
one longer, and the two are the key. Lists of such keys that are still longer than HOT are joined apart, and their
leaders are met first too. HOT, ROUND_TOKENS and LONG_SET change what is compared when, not which lines are removed.

Lines without a word (blank ones) stay. Null texts stay null; a text that loses all lines is empty. Repeated rows
(equal id and text) are treated alike; a null id comes first. Sets under 4 tokens can only match exactly. Columns
beside the named ones are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from .common import cut, discard, free_shuffles, fresh

BUCKET_BITS, HOT = 18, 512
#: The rarest tokens of a class under which it meets a leader.
ROUND_TOKENS = 2
#: Sets of more tokens have two bitmaps of 64 bits, others one.
LONG_SET = 100
#: Bits of a token below its level.
HASH_BITS = 56
#: Bytes up to which a table of keys is shipped to all executors; beyond, it is joined by shuffle.
BROADCAST_BYTES = 48_000_000


def spaced(text: Column) -> Column:
    """All white space but line feeds as spaces; texts rarely have any."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.when(odd, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row key, line number, line as it stands but for white space; of every line."""
    # the row key is made before lines are split off, once a document and not once a line
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rk"), spaced(F.col(text_col)).alias("text"))
    return keyed.select("id", "rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row key, line number, line in lower case; of every line with a word."""
    return _parts(docs, id_col, text_col).where(F.trim("line") != "").select("id", "rk", "line_no", F.lower("line").alias("line"))


def bucket_levels(docs: DataFrame, id_col: str, text_col: str) -> list[int]:
    """Level of each hash bucket, four times the logarithm of its count in all texts; a fixed number of rows."""
    flat = F.replace(F.lower(spaced(F.col(text_col))), F.lit("\n"), F.lit(" "))
    every = docs.select(F.explode(F.split(flat, " ")).alias("w")).select(_bucket(F.xxhash64("w")).alias("b"))
    level = F.least(F.floor(F.log2(F.count(F.lit(1))) * 4), F.lit(126)).cast("int")
    levels = [0] * (1 << BUCKET_BITS)
    for b, n in every.groupBy("b").agg(level.alias("n")).toLocalIterator():
        levels[b] = n
    return levels


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def _lines(docs: DataFrame, levels: list[int], id_col: str, text_col: str) -> DataFrame:
    """id, row key, line number, tokens (distinct, sorted): the level of the bucket, then the hash's lower bits."""
    table = F.from_json(F.lit("[" + ",".join(map(str, levels)) + "]"), "array<tinyint>")  # folded to one literal
    never_null = F.lit(0).cast("tinyint")  # arrays that cannot hold nulls are sorted as primitive longs

    def packed(h: Column) -> Column:
        level = F.coalesce(F.get(table, _bucket(h)), never_null)
        return F.shiftleft(level.cast("bigint"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    # what stands inside a transform is interpreted: repeats and empty words go outside, where the code is compiled
    hashes = F.transform(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), packed)
    tokens = F.array_distinct(F.array_remove(hashes, packed(F.xxhash64(F.lit("")))))
    return _rows(docs, id_col, text_col).select("id", "rk", "line_no", F.sort_array(tokens).alias("tokens"))


def _parity(flips: Callable[[Column], Column]) -> Column:
    """64 bits, each the parity of the number of tokens that flip it; a token flips its own bit if flips gives 1."""
    return F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", flips(t), t.bitwiseAND(F.lit(63)).cast("int"))))


def _bitmaps() -> list[Column]:
    """b0: over all tokens, b1: zero; of long sets: each over those of one half of the hashes."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    upper = lambda t: F.shiftrightunsigned(t, 8).bitwiseAND(one)
    long = F.size("tokens") > LONG_SET
    return [
        F.when(long, _parity(lambda t: upper(t).bitwiseXOR(one))).otherwise(_parity(lambda t: one)).alias("b0"),
        F.when(long, _parity(upper)).otherwise(zero).alias("b1"),
    ]


def _prefix_length(n: Column) -> Column:
    return n - F.ceil(n * 4 / 5).cast("int") + 1


#: What the comparison of two entries reads beside the class (k, r). m: size, position and, as the last bit, whether
#: the class is decided (has an earlier partner).
_HELD = ["m", "b0", "b1"]


def _packed(n: str, pos: str, done: str) -> Column:
    size, at = (F.shiftleft(F.col(c).cast("bigint"), k) for c, k in ((n, 33), (pos, 1)))
    return size.bitwiseOR(at).bitwiseOR(F.col(done).cast("bigint")).alias("m")


def _size(m: str) -> Column:
    return F.shiftright(m, 33)


def _position(m: str) -> Column:
    return F.shiftright(m, 1).bitwiseAND(F.lit(0xFFFFFFFF))


def _decided(m: str) -> Column:
    return F.col(m).bitwiseAND(F.lit(1)) == 1


def _may_match(x: str, y: str) -> Column:
    """Sizes, positions and bitmaps allow an overlap of 4/9 of both sizes; x and y: prefixes of the columns' names.

    Bitmaps of two sets are comparable if both are long or both are not; else those of the long one are joined.
    """
    a, b, p, q = _size(f"{x}m"), _size(f"{y}m"), _position(f"{x}m"), _position(f"{y}m")
    apart = [F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}")) for k in ("b0", "b1")]
    alike = (a > LONG_SET) == (b > LONG_SET)
    bits = F.when(alike, F.bit_count(apart[0]) + F.bit_count(apart[1])).otherwise(F.bit_count(apart[0].bitwiseXOR(apart[1])))
    # the cheapest first: of billions of pairs most end here
    return (b * 5 >= a * 4) & (a * 5 >= b * 4) & (bits * 9 <= a + b) & ((F.least(a - p, b - q)) * 9 >= (a + b) * 4)


def _small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """A stored table with a hint to ship it, if its measured size is within the bound."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def _marked(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows with the flag done: their class has an earlier partner."""
    known = _small(decided.select(F.col("k").alias("done_k"), F.col("r").alias("done_r")), 24)
    told = rows.join(known, (F.col("k") == F.col("done_k")) & (F.col("r") == F.col("done_r")), "left")
    return told.withColumn("done", F.col("done_k").isNotNull()).drop("done_k", "done_r")


def _rank(rows: DataFrame, id_col: str) -> Column:
    """A value in the order of ids that aggregates and compares fast; equal ranks are told apart when pairs are verified."""
    kind = rows.select(id_col).schema[0].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    return F.coalesce(F.col(id_col), F.lit("")) if isinstance(kind, StringType) else F.lit(0).cast("bigint")


def _leaders(entries: DataFrame) -> DataFrame:
    """Of each key the entry of the earliest class, under names with lead_; keys of one entry have none.

    Only primitive values are aggregated, so that equal keys meet on the map side first, without a sort.
    """
    found = entries.groupBy(F.col("key").alias("lead_key")).agg(
        F.min("r").alias("lead_r"), *(F.min_by(c, "r").alias(f"lead_{c}") for c in ("k", *_HELD)), F.count(F.lit(1)).alias("lead_of")
    )
    return found.where("lead_of > 1").drop("lead_of")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def _met(entries: DataFrame) -> DataFrame:
    """Pairs (u, v) of the earliest class of a key and others that may match."""
    both = entries.join(_leaders(entries), F.col("key") == F.col("lead_key"))
    return both.where((F.col("k") != F.col("lead_k")) & _may_match("", "lead_")).select(*_pair("lead_k", "k"))


def _prefix_tokens(classes: DataFrame, most: int | None = None) -> DataFrame:
    """An entry (key: the token) for each token of the prefix, or for the rarest ones."""
    tokens = F.col("prefix") if most is None else F.slice("prefix", 1, most)
    rows = classes.select("k", "r", "n", "b0", "b1", "done", "prefix", F.posexplode(tokens).alias("pos", "key"))
    return rows.where(F.col("pos") < _prefix_length(F.col("n"))).withColumn("m", _packed("n", "pos", "done"))


def _singles(classes: DataFrame, common: DataFrame) -> DataFrame:
    """Entries for each token of a prefix that is not common."""
    return _prefix_tokens(classes).join(common, F.col("key") == F.col("token2"), "left_anti").select("key", "k", "r", *_HELD)


def _doubles(classes: DataFrame, common: DataFrame) -> DataFrame:
    """Entries for each common token of a prefix and each that follows; a pair stands where its first token does."""
    told = _prefix_tokens(classes).join(common, F.col("key") == F.col("token2"))
    after = F.slice("prefix", F.col("pos") + 2, F.size("prefix"))
    pairs = F.transform(after, lambda t: F.xxhash64("key", t))
    return told.select("k", "r", *_HELD, F.explode(pairs).alias("key")).select("key", "k", "r", *_HELD)


def _later_of_similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, k2, r: of pairs (u, v) of classes the later of each at 4/5 or more; whole sets of words are compared."""
    pairs = cut(pairs, "pairs")
    ends = cut(pairs.select(F.explode(F.array("u", "v")).alias("end")).distinct(), "ends")
    sought = cut(classes.select("k", "k2", "r", "at").join(_small(ends, 16), F.col("k") == F.col("end")).drop("end"), "sought")
    rows = cut(sought.select(F.col("at.id").alias("of_id"), F.col("at.rk").alias("of")).distinct(), "rows")
    near = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("rk0"))
    near = near.join(_small(rows, 32), (F.col("rk0") == F.col("of")) & F.col("id").eqNullSafe(F.col("of_id")), "left_semi")
    here = (F.col("rk") == F.col("at.rk")) & (F.col("line_no") == F.col("at.line_no")) & F.col("id").eqNullSafe(F.col("at.id"))
    # lower case is dear beyond ASCII, so only the lines that are sought get it
    found = _parts(near, "id", "text").join(_small(sought, 80), here).select("k", "k2", "r", "at", "line").dropDuplicates(["k", "k2"])
    # a line is smaller to keep and to move than its words
    lower = found.withColumn("line", F.lower("line"))
    sets = cut(lower.withColumn("words", F.size(F.array_distinct(_words(F.col("line"))))), "sets", plain=True)
    free_shuffles(docs.sparkSession)
    one, two = (sets.select(*(F.col(c).alias(f"{x}_{c}") for c in sets.columns)) for x in "uv")
    both = pairs.join(one, F.col("u") == F.col("u_k")).join(two, F.col("v") == F.col("v_k"))
    # without repeats; named once in the condition, which would split the lines again for each mention
    shared = F.size(F.array_intersect(_words(F.col("u_line")), F.split("v_line", " ")))
    alike = both.where(shared * 9 >= (F.col("u_words") + F.col("v_words")) * 4)
    end = lambda x: F.struct(*(F.col(f"{x}_{c}").alias(c) for c in ("k", "k2", "r")))
    out = cut(alike.select(F.when(F.col("u_at") > F.col("v_at"), end("u")).otherwise(end("v")).alias("c")).select("c.*").distinct(), "later")
    discard(pairs, ends, sought, rows, sets)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rk (xxhash64 of id and text), gone: numbers of the lines to remove, from 0; documents that lose lines only."""
    spark = docs.sparkSession
    levels = bucket_levels(docs, id_col, text_col)
    free_shuffles(spark)
    n = F.size("tokens")
    prefix = F.when(n >= 4, F.slice("tokens", F.lit(1), _prefix_length(n) + 1)).alias("prefix")
    digest = [F.xxhash64("tokens").alias("k"), F.xxhash64(F.lit(1), "tokens").alias("k2")]
    lines = cut(_lines(docs, levels, id_col, text_col).select("id", "rk", "line_no", *digest, n.alias("n"), prefix, *_bitmaps()), "lines", plain=True)
    free_shuffles(spark)
    # one line of each class stands for it
    held = [F.first(c).alias(c) for c in ("n", "prefix", "b0", "b1")]
    least = F.min(F.struct("id", "rk", "line_no")).alias("at")
    firsts = lines.groupBy("k", "k2").agg(least, F.count(F.lit(1)).alias("lines"), *held)
    classes = cut(firsts.withColumn("r", _rank(firsts, "at.id")), "classes", plain=True)
    wide, lines = lines, cut(lines.select("id", "rk", "line_no", "k", "k2"), "line_keys", plain=True)
    discard(wide)
    free_shuffles(spark)

    index = classes.where("prefix is not null").select("k", "r", "n", "b0", "b1", "prefix")
    open_index = index.withColumn("done", F.lit(False))
    # only tokens of buckets with so many words can be in so many prefixes
    tokens = _prefix_tokens(open_index).where(F.shiftrightunsigned("key", HASH_BITS) >= 4 * (HOT.bit_length() - 1))
    common = cut(tokens.groupBy(F.col("key").alias("token2")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT).select("token2"), "common")
    shipped = _small(common, 24)
    doubles = cut(_doubles(open_index, shipped), "doubles", plain=True)
    hot_keys = cut(doubles.groupBy(F.col("key").alias("key2")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT).select("key2"), "hot_keys")
    is_hot, shipped_hot = F.col("key") == F.col("key2"), _small(hot_keys, 24)
    hot = doubles.join(shipped_hot, is_hot, "left_semi")
    free_shuffles(spark)

    led = _met(_prefix_tokens(open_index, ROUND_TOKENS)).unionByName(_met(hot)).distinct()
    decided = _later_of_similar(led, classes, docs, id_col, text_col)
    free_shuffles(spark)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"{name}_{c}") for c in ("key", "k", "r", *_HELD)))

    same_key = (F.col("x_key") == F.col("y_key")) & (F.col("x_k") != F.col("y_k"))
    # y is the shorter set, or of equal ones that of the smaller k, and its prefix that much shorter
    pairs = _marked(doubles.join(shipped_hot, is_hot, "left_anti"), decided).withColumn("m", F.col("m").bitwiseOR(F.col("done").cast("bigint")))
    entries = _singles(_marked(index, decided), shipped).unionByName(pairs.drop("done"))
    # no key has more than HOT entries here, so that parts are even; what the join asks of one side is said of both before
    entries = entries.where(" and ".join(f"{c} is not null" for c in entries.columns)).repartition("key")
    a, b = _size("x_m"), _size("y_m")
    shorter = (b < a) | ((b == a) & (F.col("y_k") < F.col("x_k")))
    open_ = (~_decided("y_m") & (F.col("x_r") <= F.col("y_r"))) | (~_decided("x_m") & (F.col("y_r") <= F.col("x_r")))
    # rand is below 1 and decides nothing: it keeps the condition above the shuffle, which both sides share
    early = F.when(_position("m") <= _size("m") - F.ceil(_size("m") * 8 / 9), 1.0).otherwise(0.0)
    early = F.greatest(F.rand(0), early) >= 1.0
    rest = side(entries, "x").join(side(entries.where(early), "y"), same_key & shorter & _may_match("x_", "y_") & open_).select(*_pair("x_k", "y_k"))
    # of hot keys y is the later, undecided class
    early = F.when(a <= b, _position("x_m") <= a - F.ceil(a * 8 / 9)).otherwise(_position("y_m") <= b - F.ceil(b * 8 / 9))
    undecided = side(_marked(hot, decided).where("not done"), "y")
    more = side(hot, "x").join(undecided, same_key & (F.col("x_r") <= F.col("y_r")) & early & _may_match("x_", "y_")).select(*_pair("x_k", "y_k"))
    later = cut(decided.unionByName(_later_of_similar(rest.unionByName(more).distinct(), classes, docs, id_col, text_col)).distinct(), "later")
    free_shuffles(spark)

    # lines of most classes stay: there is one, and it has no earlier partner
    gone_k = [F.col("k").alias("later_k"), F.col("k2").alias("later_k2")]
    lost = classes.join(_small(later.select(*gone_k), 24), (F.col("k") == F.col("later_k")) & (F.col("k2") == F.col("later_k2")), "left")
    lost = lost.where("lines > 1 or later_k is not null").select(F.col("k").alias("k0"), F.col("k2").alias("k02"), "at", F.col("later_k").isNotNull().alias("later"))
    lost = _small(cut(lost, "lost"), 96)
    gone = lines.join(lost, (F.col("k") == F.col("k0")) & (F.col("k2") == F.col("k02")))
    gone = gone.where(F.col("later") | (F.struct("id", "rk", "line_no") != F.col("at")))
    out = cut(gone.groupBy("id", "rk").agg(F.collect_set("line_no").alias("gone")), "removals")
    discard(lines, classes, common, doubles, hot_keys, decided, later)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents, with all their columns, without the removed lines; count_col: adds the number of these."""
    gone = removals(docs, id_col, text_col)
    total = gone.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    if total["rows"] * 64 + total["lines"] * 8 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    key, drop, same = fresh(docs, "row_key"), fresh(docs, "gone"), fresh(docs, "row_id")
    gone = gone.select(F.col("rk").alias(f"{key}_"), F.col("gone").alias(drop), F.col("id").alias(same))
    rows = docs.withColumn(key, F.xxhash64(id_col, text_col))
    rows = rows.join(gone, (F.col(key) == F.col(f"{key}_")) & F.col(id_col).eqNullSafe(F.col(same)), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    # the parts are bound once: written out inside the lambda, the text would be split again for every line
    left = F.get(F.transform(F.array(parts), lambda p: F.transform(kept, lambda i: F.get(p, i))), F.lit(0))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        columns.append(F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("bigint").alias(count_col))
    return rows.select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars, text_sha256 of the text that is left; a row per document."""
    # feeds are counted as bytes, which makes no strings of the lines
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(feeds + 1, F.lit(0)).cast("bigint").alias("n_lines")
    left = dedup_lines(docs.select("doc_id", "text", n_lines), count_col="n_removed")
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_removed", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
