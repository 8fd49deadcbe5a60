"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

A line is cut into threshold + 1 segments. If two lines are within the
threshold, some segment of the shorter occurs in the longer at one of a few
places that follow from the lengths (Li, Deng, Wang and Feng, 2011), so equal
keys of (length, segment number, segment) bring every such pair together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import by_shuffle, forget, looked_up, once, saved, shuffle_parts
from parcelyard.llm.simhash import components

EDITS = 2
#: Code points from which the shorter of two lines may differ by one edit, and by EDITS; shorter lines match only if equal.
ONE_FROM, FUZZY_FROM = 15, 30
#: Lines under one key that are compared there; above it the rest of the lines is cut again.
LARGE = 1024
#: Characters after which a pair that has no reading left is given up.
FIRST = 16
#: Repeated or linked lines (some 100 bytes each) that may be broadcast.
KNOWN_ROWS = 100_000
#: A line with more than this share of all lines is joined by broadcast (1 / HOT lines at most).
HOT = 0.001
#: Words, characters and pairs of these that one edit takes away or adds at most (a space that goes makes one word of two).
PARTS_AN_EDIT = (3, 2, 4)

_BLANK = "[\\x20\\x09-\\x0D]+"


def _trimmed(line: Column) -> Column:
    """A line without white space at its ends; bytes tell quickly that most have none."""
    octets = line.cast("binary")
    edge = F.expr("array(x'20', x'09', x'0a', x'0b', x'0c', x'0d')")
    blank = F.array_contains(edge, F.substring(octets, 1, 1)) | F.array_contains(edge, F.substring(octets, -1, 1))
    return F.when(blank, F.btrim(line, F.lit(" \t\n\x0b\f\r"))).otherwise(line)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th (a hash of the text), line_no, line (without white space at its ends), and two 64-bit hashes that tell lines apart."""
    rows = docs.select(F.col(key).alias(key), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).where("line != ''")
    return rows.select(key, "th", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _places(edits: int) -> Column:
    """Where a line's segments lie and where segments of lines shorter by up to `edits` may: an array of most, shift, i and move."""
    found = []
    for most in range(1, edits + 1):
        for shift in range(most + 1):
            for i in range(most + 1):
                for move in range(max(-i, shift - (most - i)), min(i, shift + (most - i)) + 1):
                    found.append(f"named_struct('most', {most}, 'shift', {shift}, 'i', {i}, 'move', {move})")
    return F.expr(f"array({', '.join(found)})")


def _keyed(rows: DataFrame, edits: int, one_from: int, fuzzy_from: int, cut: bool) -> DataFrame:
    """h, key and own (whether the line is indexed under the key) of every place of rows (rid, h, gid, most, rest).

    A line is indexed under its own segments. It is also looked for where
    segments of lines up to `most` shorter, which is what the row's pairs may
    differ by, may lie in it; a null `most` follows from the length, and is 1
    and edits at fuzzy_from code points. cut: also rid, gid, most, and the
    start and size of each segment.
    """
    # four bytes a code point, so that any segment is found without reading what is before it;
    # a row for each place first, so that the generated code has one key to make and stays small enough to be compiled
    rows = rows.select("rid", "h", "gid", "most", F.encode("rest", "UTF-32").alias("units"))
    rows = rows.select("rid", "h", "gid", "most", "units", F.shiftright(F.octet_length("units"), 2).alias("n"), F.explode(_places(edits)).alias("p"))
    sure = lambda x: F.coalesce(F.expr(x), F.lit(False))  # noqa: E731  (not pushed down as a null check that works out the units again)
    by_length = f"if(p.most = {edits}, n >= {fuzzy_from if edits > 1 else one_from}, p.most = 1 and n between {one_from} and {fuzzy_from})"
    rows = rows.where(sure(f"if(most is null, {by_length}, p.most = most) and n >= p.shift"))
    rows = rows.select("rid", "h", "gid", "units", "n", "p", F.expr("cast((n - p.shift) div (p.most + 1) as int)").alias("each"), F.expr("(n - p.shift) % (p.most + 1) - (p.most + 1 - p.i)").alias("over"))
    rows = rows.select("rid", "h", "gid", "units", "n", "p", F.expr("each + if(over >= 0, 1, 0)").alias("size"), F.expr("each * p.i + greatest(over, 0) + p.move").alias("at"))
    rows = rows.where(sure("at >= 0 and at + size <= n"))
    key = F.xxhash64("gid", F.col("p.most") * 256 + F.col("p.i"), F.col("n") - F.col("p.shift"), F.substring("units", F.col("at") * 4 + 1, F.col("size") * 4))
    own = F.expr("p.shift = 0 and p.move = 0").alias("own")
    return rows.select("h", key.alias("key"), own, *(["rid", "gid", "p.most", (F.col("at") + 1).alias("start"), "size"] if cut else []))


def _met(rows: DataFrame, lengths: tuple[int, int, int], depth: int) -> DataFrame:
    """_keyed rows, cut, of the keys that have at least two lines, one of them indexed; n: rows of the key.

    Keys are first counted, with sums made before the shuffle, so that a line
    or segment that is everywhere costs no more than others.
    """
    some = _keyed(rows, *lengths, False).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("ix"))
    shared = saved(some.where("lo != hi and ix").select("key"), f"shared-{depth}")
    met = saved(looked_up(_keyed(rows, *lengths, True), shared, "key").distinct(), f"met-{depth}")
    forget(shared)
    out = saved(met.join(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"), f"met-sizes-{depth}")
    forget(met)
    return out


def _parities(parts: Column) -> Column:
    """64 parities of the parts of a line, each part at the bit that its hash tells."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(63).cast("int"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(bit(w)))


def _not_followed_elsewhere(rows: DataFrame) -> DataFrame:
    """rows (h, gid, barred) without the groups whose lines all share a key under which each pair of them is followed."""
    lines = rows.select("h", "gid", "barred").distinct()
    size = lines.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    most = lines.select("gid", F.explode("barred").alias("b")).groupBy("gid", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("gid").agg(F.max("n").alias("n"))
    idle = saved(size.join(most, ["gid", "n"], "left_semi").select("gid"), "idle")
    return looked_up(rows, idle, "gid", "left_anti")


def candidates(lines: DataFrame, edits: int = EDITS, one_from: int = ONE_FROM, fuzzy_from: int = FUZZY_FROM) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of hashes h of lines (h, line) that may be within their edits, none missed; and the lines h, line that met others.

    Lines may repeat. Under a key at most LARGE lines are compared with each of
    its lines; those of more have what is left of them, without the segment
    that has met, cut again, which must be within the edits too. A pair that
    shares several large keys is looked for under the least of them alone, so
    that a clique of lines isn't cut again in every order of its segments. Of
    the pairs compared, those stay whose words and characters differ no more
    than the edits allow.
    """
    rows = lines.select(F.col("h").alias("rid"), "h", F.lit(0).cast("long").alias("gid"), F.lit(None).cast("int").alias("most"), F.col("line").alias("rest"))
    depth, pairs, done, texts = 0, None, [], None
    while True:
        met = _met(rows, (edits, one_from, fuzzy_from), depth)
        if texts is None:
            some = saved(met.select("h").distinct(), "met-lines")
            texts = looked_up(lines.select("h", "line"), some, "h").groupBy("h").agg(F.min("line").alias("line"))
            letters = F.split("line", "")
            parities = F.array(_parities(F.split("line", " ")), _parities(letters), _parities(F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters), F.lit(1))), lambda x, y: F.concat(x, y))))
            texts = saved(texts.withColumn("marks", parities), "texts")
            forget(some)
        # a segment of no characters tells nothing more: what is left is no longer than the edits
        few = (F.col("n") <= LARGE) | (F.col("size") == 0)
        side = met.where(few)
        # a pair counts under the least of the keys that it shares, and one of the two is indexed under
        keys = side.groupBy("h", "gid", "most").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("own"), F.col("key"))).alias("owned"))
        side = side.join(texts.select("h", "marks"), "h").join(keys, ["h", "gid", "most"]).select("key", "h", "own", "most", "marks", "keys", "owned")
        each = lambda z: [F.col(c).alias(f"{c}_{z}") for c in ("h", "own", "marks", "keys", "owned")]
        x, y = side.where("own").select("key", F.col("h").alias("x"), F.col("marks").alias("mx"), *each("x")), side.select("key", "most", F.col("h").alias("y"), F.col("marks").alias("my"), *each("y"))
        near = (F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~F.col("own_y"))
        for k, at_most in enumerate(PARTS_AN_EDIT):
            near &= F.bit_count(F.col("mx")[k].bitwiseXOR(F.col("my")[k])) <= at_most * F.col("most")
        shared = lambda a, b: F.array_min(F.array_intersect(f"owned_{a}", f"keys_{b}"))
        near &= F.least(shared("x", "y"), shared("y", "x")) == F.col("key")
        met_here = x.join(y, "key").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = met_here if pairs is None else pairs.unionByName(met_here)
        done.append(met)
        many = met.where(~few)
        if many.isEmpty():
            break
        # a pair is followed under the least large key that it shares, and under none if it shares one that was compared above
        owned = met.where("own").groupBy("rid", "most").agg(F.collect_set(F.struct("key", few.alias("few"))).alias("owned"))
        many = many.join(owned, ["rid", "most"], "left")
        elsewhere = F.transform(F.filter(F.coalesce("owned", F.array()), lambda k: k["few"] | (k["key"] < F.col("key"))), lambda k: k["key"])
        if depth:
            left = many.join(by_shuffle(rows.select("rid", "rest", "barred")), "rid")
        else:
            left = many.join(texts.select("h", F.col("line").alias("rest"), F.array().cast("array<long>").alias("barred")), "h")
        # the rest shrinks by the segment, so the cuts end
        after = F.col("start") + F.col("size")
        rest = F.concat(F.substring("rest", F.lit(1), F.col("start") - 1), F.substring(F.col("rest"), after, F.length("rest")))
        barred = F.sort_array(F.array_union("barred", elsewhere))
        cut = left.select("h", F.col("key").alias("gid"), "most", rest.alias("rest"), barred.alias("barred")).distinct()
        cut = saved(cut.withColumn("rid", F.xxhash64("h", "gid", "rest", "barred")), f"cut-{depth}")
        rows = saved(_not_followed_elsewhere(cut), f"rest-{depth}")
        forget(cut)
        done.append(rows)
        depth += 1
        if rows.isEmpty():
            break
    out = saved(pairs.distinct(), "candidates")
    forget(*done)
    return out, texts


def _common(a: Column, b: Column, end: bool) -> Column:
    """Length of the common prefix (or suffix) of two strings, by halving."""
    cut = (lambda s, n: F.substring(s, -n, n)) if end else (lambda s, n: F.substring(s, F.lit(1), n))
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(F.filter(steps, lambda s: s <= most), F.lit(0), lambda p, s: F.when((p + s <= most) & (cut(a, p + s) == cut(b, p + s)), p + s).otherwise(p))


def _characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _band(a: Column, b: Column, edits: int, steps: Column) -> Column:
    """States of the diagonals about the main one after some characters of b, a number for each count of edits.

    Level k has a bit for each of the 2 * edits + 1 diagonals: set while some
    reading with at most k edits is there. One step of all levels takes the
    next character of b.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def levels(got: list[Column]) -> Column:
        return F.struct(*[x.cast("int").alias(f"r{k}") for k, x in enumerate(got)])

    first = [1 << edits]
    for _ in range(edits):
        first.append((first[-1] | first[-1] << 1) & full)

    def step(r: Column, i: Column) -> Column:
        same = F.lit(0)
        for d in range(width):
            j = i + d - edits  # 1-based place in a
            same = same + F.when((j >= 1) & (F.get(a, j - 1) == F.get(b, i - 1)), 1 << d).otherwise(0)
        now = [r["r0"].bitwiseAND(same)]
        for k in range(1, edits + 1):
            below = r[f"r{k - 1}"]
            x = r[f"r{k}"].bitwiseAND(same).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(now[-1], 1))
            now.append(x.bitwiseAND(full))
        return levels(now)

    taken = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(taken, levels([F.lit(x) for x in first]), step)


def banded_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays of characters, or null above the edits."""
    end = F.size(a) - F.size(b) + edits
    last = _band(a, b, edits, F.size(b))
    ends = [F.call_function("shiftright", last[f"r{k}"], end).bitwiseAND(1) for k in range(edits + 1)]
    # each level holds the one below, so the distance is how many levels miss the end
    missed = edits + 1 - sum(ends[1:], ends[0])
    return F.when(F.abs(F.size(a) - F.size(b)) <= edits, F.nullif(missed, F.lit(edits + 1)))


def _starts_alike(a: Column, b: Column, edits: int) -> Column:
    """Whether any reading of the first characters is within the edits; most pairs that aren't alike end here."""
    return _band(a, b, edits, F.least(F.size(b), F.lit(FIRST)))[f"r{edits}"] != 0


def links(lines: DataFrame, edits: int = EDITS, one_from: int = ONE_FROM, fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of distinct lines (h, line) within the edits that the shorter one's length allows."""
    pairs, text = candidates(lines, edits, one_from, fuzzy_from)
    pairs = pairs.repartition(shuffle_parts(lines.sparkSession))
    of = lambda z: by_shuffle(text.select(F.col("h").alias(z), F.col("line").alias(f"t{z}")))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    n = F.least(F.length("ta"), F.length("tb"))
    both = both.withColumn("most", F.when(n >= fuzzy_from, edits).when(n >= one_from, F.least(F.lit(1), F.lit(edits))).otherwise(0))
    both = both.where(F.abs(F.length("ta") - F.length("tb")) <= F.col("most"))
    both = both.withColumn("p", _common(F.col("ta"), F.col("tb"), False))
    tail = lambda c: F.substring(F.col(c), F.col("p") + 1, F.length(c))
    both = both.select("a", "b", "most", tail("ta").alias("ta"), tail("tb").alias("tb"))
    both = both.withColumn("s", _common(F.col("ta"), F.col("tb"), True))
    head = lambda c: F.substring(F.col(c), F.lit(1), F.length(c) - F.col("s"))
    # written, so that the characters are read as columns rather than worked out again at every step
    both = saved(both.select("a", "b", "most", _characters(head("ta")).alias("ta"), _characters(head("tb")).alias("tb")), "unequal-middles")
    ta, tb = F.col("ta"), F.col("tb")
    return both.where(_starts_alike(ta, tb, edits) & (banded_distance(ta, tb, edits) <= F.col("most"))).select("a", "b")


def _classes(lines: DataFrame, key: str, edits: int, one_from: int, fuzzy_from: int) -> tuple[DataFrame, DataFrame]:
    """The written places (key, th, line_no, h, h2) of lines, and what is to be said of lines that aren't alone: h, h2, class, n_links, n."""
    places = saved(lines.select(key, "th", "line_no", "h", "h2"), "lines")
    at = F.struct(F.col(key), F.col("line_no"), F.col("th"))
    repeated = places.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    linked = saved(links(lines, edits, one_from, fuzzy_from), "line-links")
    wanted = saved(repeated.unionByName(linked.select(F.explode(F.array("a", "b")).alias("h"))).distinct(), "lines-wanted")
    info = saved(looked_up(places, wanted, "h").groupBy("h", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")), "line-info")
    ends = linked.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(linked).select(F.col("node").alias("h"), "root")
    near = info.join(ends, "h").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    firsts = near.groupBy("root").agg(F.min("first").alias("class"))
    near = saved(near.join(firsts, "root").select("h", "h2", "class", "n_links"), "line-classes")
    known = info.join(near, ["h", "h2"], "left").where("n > 1 or n_links > 0")
    known = saved(known.select("h", "h2", F.coalesce("class", "first").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n"), "line-known")
    forget(wanted, info, linked, near)
    return places, known


def _told(places: DataFrame, known: DataFrame) -> DataFrame:
    """places with the known columns, null for lines that are alone; lines that are everywhere are joined by broadcast."""
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if known.count() <= KNOWN_ROWS:
        return places.join(F.broadcast(known), ["h", "h2"], "left")
    hot = F.col("n") > max(1, int(total * HOT))
    often = F.broadcast(known.where(hot))
    other = places.join(often, ["h", "h2"], "left_anti").join(by_shuffle(known.where(~hot)), ["h", "h2"], "left")
    return places.join(often, ["h", "h2"]).unionByName(other)


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, one_from: int = ONE_FROM, fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """A row for each line with a character that isn't white space.

    key, line_no (from 0), class_doc and class_line (where the line's class
    occurs first), n_links (other distinct lines within the edits) and kept
    (whether it is that first line). Equal lines are linked, and lines within
    the edits: `edits` where the shorter has at least fuzzy_from code points,
    one from one_from on, none below. Classes are what links reach. White space
    at a line's ends doesn't count. Null and empty texts have no line. A null
    key comes first. Rows with one key count as one document: of its places
    with one number that of the text with the least hash comes first. Lines are told
    apart by two 64-bit hashes.
    """
    places, known = _classes(lines_of(docs, key, text), key, edits, one_from, fuzzy_from)
    alone = F.col("n").isNull()
    class_doc, class_line = F.when(alone, F.col(key)).otherwise(F.col("class")[key]), F.when(alone, F.col("line_no")).otherwise(F.col("class.line_no"))
    return _told(places, known).select(
        key, F.col("line_no").cast("int").alias("line_no"), class_doc.alias("class_doc"), class_line.cast("int").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), _is_first(key).alias("kept"),
    )


def _is_first(key: str) -> Column:
    own = F.col("class")[key].eqNullSafe(F.col(key)) & (F.col("class.line_no") == F.col("line_no"))
    return F.col("n").isNull() | (own & (F.col("class.th") == F.col("th")))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, one_from: int = ONE_FROM, fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """docs whose texts keep only lines that are the first of their class, and blank ones.

    A text that has lines but keeps none is dropped; a null or blank text stays.
    Of rows with one key and one text a single one is kept. Rows with one key
    (null is one) and different texts lose only lines that repeat elsewhere. Any
    other columns are carried along.
    """
    rows = once(docs, key, text)
    places, known = _classes(lines_of(rows, key, text), key, edits, one_from, fuzzy_from)
    gone = _told(places, known).where(~_is_first(key))
    gone = gone.groupBy("th", key).agg(F.collect_set("line_no").alias("gone"))
    names, value = rows.columns, F.col("row")[text]
    both = rows.select(F.struct(*names).alias("row"))
    both = both.join(gone, (F.xxhash64(value) == F.col("th")) & F.col("row")[key].eqNullSafe(F.col(key)), "left")
    kept = F.filter(F.split(value, "\n"), lambda line, i: ~F.array_contains("gone", i))
    out = F.when(F.col("gone").isNull(), value).otherwise(F.array_join(kept, "\n"))
    both = both.select("row", out.alias("left"), "gone").where(F.col("gone").isNull() | (F.regexp_replace("left", _BLANK, "") != "") | (F.regexp_replace(value, _BLANK, "") == ""))
    return both.select(*[F.col("left").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS line_no, regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
), t AS MATERIALIZED (
  SELECT line, length(line) AS n, arg_min({'d': doc_id, 'i': line_no}, (doc_id, line_no)) AS first, row_number() OVER (ORDER BY min((doc_id, line_no)), line) AS id
  FROM l WHERE line <> '' GROUP BY line
), e AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON y.n BETWEEN x.n - 2 AND x.n + 2 AND x.id <> y.id
  WHERE x.n >= 15 AND y.n >= 15 AND levenshtein(x.line, y.line) <= CASE WHEN least(x.n, y.n) >= 30 THEN 2 ELSE 1 END
), r AS (
  SELECT id AS a, id AS b FROM t WHERE id IN (SELECT a FROM e)
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT t.id, coalesce(m.b, t.id) AS root, coalesce(k.n, 0) AS n_links
  FROM t LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = t.id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = t.id
)
SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no, f.first.d AS class_doc, CAST(f.first.i AS INTEGER) AS class_line, CAST(c.n_links AS BIGINT) AS n_links,
  f.first.d = l.doc_id AND f.first.i = l.line_no AS kept
FROM l JOIN t ON l.line = t.line JOIN c ON c.id = t.id JOIN t f ON f.id = c.root
"""
