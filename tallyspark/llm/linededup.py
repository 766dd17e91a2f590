"""Lines that repeat, exactly or within an edit, over all documents: a segment-partition edit join in SQL functions.

Of equal lines the first occurrence stays, by document id and place; a line that lies within `threshold` edits of one
that occurs earlier goes. Longer lines may differ by more edits: without a threshold, the shorter line of a pair gives it
by EDITS. Lines are compared without blanks at their ends; blank lines always stay.

1. Each long enough line is cut into threshold + 1 segments, the first half of them from its beginning, the others from its
   end, of a size that a class of lengths has in common. One of them must occur unchanged in any line within threshold
   edits: the k-th from either end at most k places off, as fewer edits lie beyond it. Segments and the substrings to
   probe with are keyed by (segment number, length class, text); a line probes the next lower class too if it is near.
2. Keys are counted before rows meet; a Bloom filter of those that two different lines share thins the second scan.
3. Small groups of a key are compared pair by pair: at threshold 1 with a banded bit-parallel edit distance of what is left
   beside the segment, at higher ones as a whole, by Spark's own banded edit distance.
4. A large group at threshold 1 is cut again: what is left beside the segment into blocks, of which all but one must match.
5. At higher thresholds each line of a large group is first compared with the group's earliest, as one earlier line is enough
   for it to go. Where the group differs in a long stretch, a semi-join tells the others that have an earlier one: its
   condition first asks if the parities of the lines' pairs of letters allow for threshold edits, then the edit distance.
   So thousands of variants of a paragraph cost their square in tests of a few words of bits, but never in rows. Groups that differ in a short stretch only (a
   number in a template), or beyond SIFT lines, are cut again: what is left beside the segment, less what all of the group
   have in common at its ends, is cut into threshold + 1 segments once more, of which one must match again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import shared
from tallyspark.llm.bloom import Bloom

#: Lengths from which lines may differ by so many edits: one for 25 characters, 1 to 3 in all.
EDITS = ((0, 1), (50, 2), (75, 3))
#: Shorter lines are compared exactly only: an edit in twenty characters may change what a heading or a number says.
LEAST_CHARS = 20
#: Groups of a key up to this size are compared pair by pair; above one edit up to CROWD, as word_bits() settles most pairs.
PAIRWISE, CROWD = 16, 64
#: Larger groups up to SIFT lines that differ in a stretch of SPAN characters or more are sifted by gram_bits() in their join.
SIFT, SPAN = 1 << 15, 64
#: Up to so many characters the edit distance is taken inside that join; longer lines become pairs, as its time grows with the square.
WITHIN_JOIN = 4096
BLOCKS = 8
#: Common beginnings and ends of two lines are left out in steps of this part of the shorter one.
STRIPS = 16
FILTER_BITS = 1 << 26
#: Lines with more than one in HOT of all repeated occurrences (so fewer than HOT of them) are dealt over SALTS tasks.
HOT, SALTS = 1000, 64
BLANKS = " \t\r"


# ---------------------------------------------------------------- edit distance


def edit_distance(x: Column, y: Column, threshold: int) -> Column:
    """The edit distance of two strings if it is at most threshold, else more than that (Hyyro's banded bit vectors).

    Bit b of a vector stands for row t - threshold + b of the band at column t. The distance is followed along the
    diagonal that ends in the last cell.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    long = lambda v: F.lit(v).cast("long")
    held = F.struct(F.split(x, "").alias("xs"), F.split(y, "").alias("ys"), F.length(x).alias("nx"), F.length(y).alias("ny"))
    # bound to a variable, the letters are cut once and not for every cell
    return F.get(F.transform(F.array(held), lambda v: _banded(v, threshold, width, mask, long)), F.lit(0))


def _banded(held: Column, threshold: int, width: int, mask: int, long: Callable[[int], Column]) -> Column:
    xs, ys, nx, ny = (held[k] for k in ("xs", "ys", "nx", "ny"))
    ends = nx - ny  # the diagonal

    def matches(t: Column) -> Column:
        c = F.get(ys, t)
        bits = [F.when(F.get(xs, t - threshold + b) == c, long(1 << b)).otherwise(long(0)) for b in range(width)]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        return total

    def step(state: Column, item: Column) -> Column:
        vp, vn, m = state["vp"], state["vn"], item["m"]
        zero = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(long(mask))

        def then(d0: Column) -> Column:
            hp = vn.bitwiseOR(long(mask).bitwiseXOR(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            kept = F.call_function("shiftrightunsigned", d0, F.lit(threshold) + ends).bitwiseAND(long(1))
            counts = F.when(item["t"] + 1 + ends > 0, 1 - kept).otherwise(long(0))
            return F.struct(
                hn.bitwiseOR(long(mask).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["d"] + counts).alias("d"),
            )

        return F.get(F.transform(F.array(zero), then), F.lit(0))

    start = F.struct(long(mask ^ ((1 << threshold) - 1)).alias("vp"), long(0).alias("vn"), F.abs(ends).cast("long").alias("d"))
    items = F.transform(F.sequence(F.lit(0), F.greatest(ny - 1, F.lit(0))), lambda t: F.struct(t.alias("t"), matches(t).alias("m")))
    found = F.aggregate(items, start, step)["d"]
    return F.when(F.abs(ends) > threshold, long(threshold + 1)).when(ny == 0, nx.cast("long")).otherwise(found)


# ---------------------------------------------------------------- candidates


def _classes(threshold: int | None, least_chars: int) -> list[tuple[int, int, int | None]]:
    """(edits, least length, length to stay below) for the shorter line of a pair."""
    if threshold is not None:
        return [(threshold, least_chars, None)]
    ends = [begin for begin, _ in EDITS[1:]] + [None]
    return [(edits, max(begin, least_chars), end) for (begin, edits), end in zip(EDITS, ends) if end is None or least_chars < end]


def _length_class(n: Column, threshold: Column | int) -> Column:
    """The length rounded down to three binary digits, which leaves four classes between powers of two, but to 1, 2 or 4
    characters at least for 1, 2 or 3 edits: lengths within threshold of each other are in one class or in adjacent ones."""
    spare = F.greatest(F.length(F.bin(n.cast("long"))) - 3, (F.lit(threshold) - 1).cast("int"))
    return F.call_function("shiftleft", F.call_function("shiftright", n, spare), spare)


def _probes(edits: int, near: bool) -> Column:
    """What to look up of a text: the segment's number, whether it counts from the left, its number from there, how far off it is
    looked for, whether the next lower class is meant, and the role. A constant, as expressions for each probe would make methods
    that the JVM doesn't compile."""
    out = []
    for lower in range(2 if near else 1):
        for i in range(edits + 1):
            left = i < (edits + 1) // 2
            k = i if left else edits - i
            out += [(16 * edits + i, left, k, shift, bool(lower), 2 if lower or shift else 3) for shift in range(-k, k + 1)]
    names = ("code", "left", "k", "shift", "lower", "role")
    return F.array(*[F.struct(*[F.lit(v).alias(name) for v, name in zip(probe, names)]) for probe in out])


def _segments(lines: DataFrame, text: str, threshold: Column | int, *columns: str, group: str | None = None) -> DataFrame:
    """A row for each substring of a text to look up: columns, key, role, start, size. Role 3 is for a text's own segments,
    which also probe, 2 for other probes.

    threshold: a number, or a column of numbers from 1 to 3, which the key tells apart. group: a column that must agree
    besides. Texts of threshold or fewer characters have no segments, nor have those of 3 at two edits.
    """
    n, own, lower, t, p = shared.unused([*columns, text], "__n", "__own", "__lower", "__t", "__p")
    ready = lines.withColumn(n, F.length(text)).withColumn(t, threshold if isinstance(threshold, Column) else F.lit(threshold))
    ready = ready.withColumn(own, _length_class(F.col(n), F.col(t))).withColumn(lower, _length_class(F.greatest(F.col(n) - F.col(t), F.lit(0)), F.col(t)))
    choice = None
    for edits in (1, 2, 3) if isinstance(threshold, Column) else (threshold,):
        for near in (False, True):
            some = (F.col(t) == edits) & (F.col(lower) == F.col(own) if not near else F.col(lower) != F.col(own))
            choice = F.when(some, _probes(edits, near)) if choice is None else choice.when(some, _probes(edits, near))
    cut = ready.select("*", F.explode(choice).alias(p))
    held = F.when(F.col(f"{p}.lower"), F.col(lower)).otherwise(F.col(own))
    size = F.floor(held / (F.col(t) + 1)).cast("int")
    start = F.when(F.col(f"{p}.left"), size * F.col(f"{p}.k")).otherwise(F.col(n) - size * (F.col(f"{p}.k") + 1)) + F.col(f"{p}.shift")
    told = (F.col(f"{p}.code"), held, *([group] if group else []))
    # Of bytes a piece is found at once, of characters by going through all before it; both hash the same bytes
    bytewise = F.xxhash64(*told, F.substring(F.col(text).cast("binary"), start + 1, size))
    key = F.when(F.octet_length(text) == F.col(n), bytewise).otherwise(F.xxhash64(*told, F.col(text).substr(start + 1, size)))
    # generated, the key stays one column; as an expression it would be put wherever it is used
    found = cut.where(size > 0).select(*columns, F.explode(F.array(F.struct(key.alias("key"), F.col(f"{p}.role").alias("role"), start.alias("start"), size.alias("size")))).alias(p))
    return found.select(*columns, f"{p}.*")


def _blocks(text: Column, group: Column) -> Column:
    """array<struct<key, role, rest>>: the text without one of BLOCKS blocks as the key, that block as the rest."""
    n, out = F.length(text), []
    for less in range(2):
        target = n - less
        for b in range(BLOCKS):
            begin = F.floor(target * b / BLOCKS).cast("int")
            after = target - F.floor(target * (b + 1) / BLOCKS).cast("int")
            key = F.xxhash64(group, F.lit(b), target, text.substr(F.lit(1), begin), text.substr(n - after + 1, after))
            rest = text.substr(begin + 1, n - after - begin)
            out.append(F.struct(F.when(target >= 0, key).alias("key"), F.lit(2 if less else 3).alias("role"), rest.alias("rest")))
    return F.array(*out)


def _crowded(rows: DataFrame) -> DataFrame:
    """Keys that two different lines share, one of them by a segment of its own."""
    seen = rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.expr("bit_or(role)").alias("roles"))
    return seen.where("key is not null and low != high and (roles & 1) = 1").select("key")


def _last(name: str, n: Column) -> Column:
    return F.substring(name, F.length(name) - n + 1, n)


def _agreeing(length: Column, agree: Callable[[Column], Column]) -> Column:
    """The largest multiple of length / STRIPS, rounded down, that agrees; common ends leave the edit distance as it is."""
    found = F.lit(0)
    for k in range(1, STRIPS + 1):
        size = F.floor(length * k / STRIPS).cast("int")
        found = F.when(agree(size), size).otherwise(found)
    return found


def close(x: Column, y: Column, threshold: int) -> Column:
    """Whether two strings are within threshold edits.

    Of STRIPS pieces of the one all but threshold must be in the other, at most threshold places off; that settles most
    pairs. For the others common ends are left out and Spark's banded edit distance decides, whose time grows with the square.
    """
    shifts = F.array(*[F.lit(s) for s in sorted(range(-threshold, threshold + 1), key=abs)])

    def bound(v: Column) -> Column:
        def there(k: Column) -> Column:
            begin = F.floor(v["n"] * k / STRIPS).cast("int")
            size = F.floor(v["n"] * (k + 1) / STRIPS).cast("int") - begin
            return F.exists(shifts, lambda s: v["x"].substr(begin + 1, size) == v["y"].substr(begin + 1 + s, size))

        pieces = F.size(F.filter(F.sequence(F.lit(0), F.lit(STRIPS - 1)), there))
        head = _agreeing(v["least"], lambda k: v["x"].substr(F.lit(1), k) == v["y"].substr(F.lit(1), k))
        tail = _agreeing(v["least"], lambda k: v["x"].substr(v["n"] - k + 1, k) == v["y"].substr(v["m"] - k + 1, k))
        ends = F.struct(head.alias("head"), tail.alias("tail"))

        def middle(e: Column) -> Column:
            end = F.least(e["tail"], v["least"] - e["head"])
            x, y = (v[c].substr(e["head"] + 1, v[n] - e["head"] - end) for c, n in (("x", "n"), ("y", "m")))
            return F.levenshtein(x, y, threshold) >= 0

        near = (F.abs(v["n"] - v["m"]) <= threshold) & (pieces >= STRIPS - threshold)
        return F.when(near, F.get(F.transform(F.array(ends), middle), F.lit(0))).otherwise(F.lit(False))

    held = F.struct(x.alias("x"), y.alias("y"), F.length(x).alias("n"), F.length(y).alias("m"), F.least(F.length(x), F.length(y)).alias("least"))
    return F.get(F.transform(F.array(held), bound), F.lit(0))


def _later(members: DataFrame) -> DataFrame:
    """h1, h2 of the later line of each pair of members of a key whose rests are within one edit."""
    a, b = members.alias("a"), members.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.role") == 3) & ((F.col("b.role") == 2) | (F.col("a.h1") < F.col("b.h1"))) & (F.col("a.h1") != F.col("b.h1"))
    pairs = a.join(b, meet).where(F.abs(F.length("a.rest") - F.length("b.rest")) <= 1)
    pairs = pairs.select("a.h1", "a.h2", "a.first", F.col("b.h1").alias("o1"), F.col("b.h2").alias("o2"), F.col("b.first").alias("other"), F.col("a.rest").alias("x"), F.col("b.rest").alias("y"))
    own = F.col("first") > F.col("other")
    later = (F.when(own, F.col("h1")).otherwise(F.col("o1")).alias("h1"), F.when(own, F.col("h2")).otherwise(F.col("o2")).alias("h2"))
    least = F.least(F.length("x"), F.length("y"))
    head = _agreeing(least, lambda k: F.substring("x", F.lit(1), k) == F.substring("y", F.lit(1), k))
    tail = _agreeing(least, lambda k: _last("x", k) == _last("y", k))
    same = pairs.withColumns({"least": least, "head": head, "tail": tail})
    # written, as the optimizer would put these long expressions wherever their columns are used
    same = shared.stored(same, "line-pairs").withColumn("tail", F.least("tail", F.col("least") - F.col("head")))
    # all but the block with the edit must agree
    same = same.where(F.col("least") - F.col("head") - F.col("tail") <= F.col("least") / STRIPS + 2)
    middle = lambda c: F.substring(c, F.col("head") + 1, F.length(c) - F.col("head") - F.col("tail"))
    return same.where(edit_distance(middle("x"), middle("y"), 1) <= 1).select(*later)


def word_bits(line: Column) -> Column:
    """64 bits, of which each word between blanks turns over one. An edit changes one word, parts one or joins two, so it
    turns over three bits at most: lines within t edits differ in 3 t bits at most."""
    turn = lambda bits, word: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int")))
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), turn)


def _alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether the bits of two lines allow for no more than threshold edits."""
    return F.bit_count(a.bitwiseXOR(b)) <= 3 * threshold


GRAM_WORDS = 4
GRAMS = [f"g{k}" for k in range(GRAM_WORDS)]


def gram_bits(line: Column) -> Column:
    """struct<g0, ..>: GRAM_WORDS times 64 bits, of which each two adjacent characters turn over one. An edit takes two pairs
    away and adds two at most, so lines within t edits differ in 4 t bits at most; another word for one turns over more."""
    zero = F.lit(0).cast("long")

    def turn(state: Column, letter: Column) -> Column:
        place = (state["last"] * 27 + F.ascii(letter)).bitwiseAND(F.lit(64 * GRAM_WORDS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))
        words = [F.when(F.shiftright(place, 6) == k, state[f"g{k}"].bitwiseXOR(bit)).otherwise(state[f"g{k}"]).alias(f"g{k}") for k in range(GRAM_WORDS)]
        return F.struct(F.ascii(letter).alias("last"), *words)

    start = F.struct(F.lit(0).alias("last"), *[zero.alias(f"g{k}") for k in range(GRAM_WORDS)])
    return F.aggregate(F.split(line, ""), start, turn)


def _with_grams(members: DataFrame) -> DataFrame:
    """members with the columns of gram_bits(), which are made once for each line."""
    lines = members.groupBy("h1").agg(F.any_value("line").alias("line"))
    grams = shared.stored(lines.select("h1", gram_bits(F.col("line")).alias("g")), "line-grams")
    return members.join(grams.select("h1", *[f"g.{g}" for g in GRAMS]), "h1")


def _meet(threshold: int, grams: list[str]) -> Column:
    """When a member a meets one b of its key that occurs earlier and is as near as lengths and bits can tell."""
    same = (F.col("a.key") == F.col("b.key")) & ((F.col("a.role") == 3) | (F.col("b.role") == 3)) & (F.col("a.first") > F.col("b.first")) & (F.col("a.h1") != F.col("b.h1"))
    near = (F.abs(F.col("a.n") - F.col("b.n")) <= threshold) & _alike(F.col("a.bits"), F.col("b.bits"), threshold)
    if grams:
        near = near & (sum((F.bit_count(F.col(f"a.{g}").bitwiseXOR(F.col(f"b.{g}"))) for g in grams), F.lit(0)) <= 4 * threshold)
    return same & near


def _near_earlier(members: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """h1, h2 of the members with gram_bits() that are within threshold edits of an earlier one of their key, but those found:
    a semi-join, so a row for each at most."""
    b = members.select("key", "role", "h1", "first", "line", F.length("line").alias("n"), "bits", *GRAMS).alias("b")
    a = members.where(F.length("line") <= WITHIN_JOIN).join(found, ["h1", "h2"], "left_anti")
    a = a.select("key", "role", "h1", "h2", "first", "line", F.length("line").alias("n"), "bits", *GRAMS).alias("a")
    near = _meet(threshold, GRAMS) & (F.levenshtein(F.col("a.line"), F.col("b.line"), threshold) >= 0)
    return a.join(b, near, "left_semi").select("h1", "h2").distinct()


def _open_pairs(members: DataFrame, found: DataFrame | None, seen: DataFrame | None, threshold: int) -> DataFrame:
    """h1, o1: pairs of members of a key, the later line first, but those that were compared before or whose later line is known to go.

    Members with gram_bits() meet as rows only if these allow for so few edits too.
    """
    grams = [c for c in members.columns if c in GRAMS]
    a, b = (members.select("key", "role", "h1", "h2", "first", F.length("line").alias("n"), "bits", *grams).alias(x) for x in "ab")
    pairs = a.join(b, _meet(threshold, grams)).select("a.h1", "a.h2", F.col("b.h1").alias("o1"))
    pairs = pairs if found is None else pairs.join(found, ["h1", "h2"], "left_anti")
    pairs = pairs.select("h1", "o1").distinct()
    return pairs if seen is None else pairs.join(seen, ["h1", "o1"], "left_anti")


def near_lines(lines: DataFrame, threshold: int | None = None, least_chars: int = LEAST_CHARS, pairwise: int = PAIRWISE) -> DataFrame:
    """h1, h2 of the lines within threshold edits, or those of EDITS, of one that occurs earlier; lines: h1, h2, place, line.

    place orders occurrences. A line takes part at every number of edits that it may share with a shorter or longer one.
    """
    length, edits = F.length("line"), []
    for t, low, below in _classes(threshold, least_chars):
        edits.append(F.when((length >= low) & (F.lit(True) if below is None else length < below + t), F.array(F.lit(t))).otherwise(F.array().cast("array<int>")))
    some = lines.withColumn("edits", F.explode(F.concat(*edits)))  # no lambdas, which would keep the scan out of generated code
    keyed = _segments(some, "line", F.col("edits"), "h1")
    crowded = shared.stored(_crowded(keyed), "line-keys")
    bloom = Bloom(crowded, "key", min(FILTER_BITS, 1 << max(16, (10 * crowded.count()).bit_length())), 4)
    again = _segments(some, "line", F.col("edits"), "h1", "h2", "place", "line", "edits").where(bloom.holds(F.col("key")))
    rest = _without(F.col("line"), F.col("start"), F.col("size"))
    exact = again.select("h1", "h2", "place", "key", "role", "edits", rest.alias("rest"), F.when(F.col("edits") > 1, F.col("line")).alias("line")).join(crowded, "key")
    exact = exact.withColumn("bits", F.when(F.col("edits") > 1, word_bits(F.col("line"))))
    exact = shared.stored(_members(exact, "edits"), "line-members")
    shared.remove(lines.sparkSession, crowded)
    found = None
    for t, *_ in _classes(threshold, least_chars):
        members = exact.where(F.col("edits") == t).drop("edits")
        own = _within_keys(members, t, pairwise) if t > 1 else _within_blocks(members, pairwise)
        found = own if found is None else found.union(own)
    shared.remove(lines.sparkSession, exact)
    return found.distinct()


def _members(rows: DataFrame, *more: str) -> DataFrame:
    """A line that occurs often is one member of a key, with its first place."""
    return rows.groupBy("key", "h1", "role", "rest", *more).agg(F.min("place").alias("first"), F.any_value("h2").alias("h2"), F.any_value("line").alias("line"), F.any_value("bits").alias("bits"))


def _within_blocks(members: DataFrame, pairwise: int) -> DataFrame:
    """h1, h2 of the members of each key whose rests are within one edit of that of an earlier one."""
    found = None
    while True:
        sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("rest")).alias("longest"))
        small = (F.col("n") <= pairwise) | (F.col("longest") <= 2)
        some = sizes.where(small).where("n > 1").select("key")
        later = shared.stored(_later(members.join(some, "key")).distinct(), "line-later")
        found = later if found is None else found.union(later)
        large = sizes.where(~small).select("key")
        if large.isEmpty():
            return found.distinct()
        left = members.join(large, "key")
        cut = left.select("h1", "h2", F.col("first").alias("place"), F.explode(_blocks(F.col("rest"), F.col("key"))).alias("s"))
        cut = shared.stored(cut.select("h1", "h2", "place", "s.key", "s.role", "s.rest"), "line-blocks")
        members = shared.stored(_members(cut.join(_crowded(cut), "key").withColumns({"line": F.lit(None).cast("string"), "bits": F.lit(None).cast("long")})), "line-members")
        shared.remove(members.sparkSession, cut)


def _without(text: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), text.substr(start + size + 1, F.length(text)))


def _within_keys(members: DataFrame, threshold: int, pairwise: int) -> DataFrame:
    """h1, h2 of the members of each key that are within threshold edits of an earlier one.

    Large groups that differ in a long stretch are sifted by gram_bits(). For the others every level takes a segment off the
    rests, until no more than a few characters are left: there all pairs are compared, of which there can't be many, as all
    else of these lines agrees. Only keys go on in which a line that isn't known to go has an earlier one.
    """
    found = seen = None
    while True:
        counted = shared.stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "line-sizes")
        crowd = F.col("n") > max(pairwise, CROWD)
        length, turned = F.length("rest"), F.reverse("rest")
        sizes = members.join(counted.where(crowd).select("key"), "key").groupBy("key").agg(
            F.count("*").alias("n"), F.min(F.struct("first", "h1", "line", "bits")).alias("earliest"), F.max(length).alias("longest"), F.min(length).alias("least"),
            F.max(F.length("line")).alias("line_length"), F.min("rest").alias("low"), F.max("rest").alias("high"), F.min(turned).alias("low_end"), F.max(turned).alias("high_end"),
        )
        # what the least and the greatest of some texts have in common at the beginning, all have
        head = _agreeing(F.col("least"), lambda k: F.substring("low", F.lit(1), k) == F.substring("high", F.lit(1), k))
        tail = _agreeing(F.col("least"), lambda k: F.substring("low_end", F.lit(1), k) == F.substring("high_end", F.lit(1), k))
        sizes = sizes.withColumn("head", head).withColumn("tail", F.least(tail, F.col("least") - F.col("head"))).drop("low", "high", "low_end", "high_end", "least")
        sizes = shared.stored(sizes, "line-sizes")
        span = F.col("longest") - F.col("head") - F.col("tail")
        last = span <= 2 * threshold + 1
        sifted = (span >= SPAN) & (F.col("n") <= SIFT)
        # plans for groups that there are none of would only take the driver's memory
        has = sizes.agg(F.max(~last).alias("large"), F.max(~last & sifted).alias("sifted"), F.max(~last & sifted & (F.col("line_length") > WITHIN_JOIN - threshold)).alias("long"), F.max(~last & ~sifted).alias("cut")).first()
        paired = counted.where(~crowd).select("key").union(sizes.where(last).select("key"))
        large = members.join(sizes.where(~last), "key")
        if has["large"]:
            unsettled = large.where((F.col("first") > F.col("earliest.first")) & _alike(F.col("bits"), F.col("earliest.bits"), threshold))
            unsettled = unsettled if found is None else unsettled.join(found, ["h1", "h2"], "left_anti")
            against = unsettled.select("h1", "h2", "line", F.col("earliest.h1").alias("o1"), F.col("earliest.line").alias("other")).dropDuplicates(["h1", "o1"])
            settled = shared.stored(against.where(close(F.col("line"), F.col("other"), threshold)).select("h1", "h2").distinct(), "line-later")
            found = settled if found is None else found.union(settled)
        if has["sifted"]:
            sieve = _with_grams(members.join(sizes.where(~last & sifted).select("key"), "key"))
            found = found.union(shared.stored(_near_earlier(sieve, found, threshold), "line-later"))
        pairs = _open_pairs(members.join(paired, "key"), found, seen, threshold)
        if has["long"]:
            pairs = pairs.union(_open_pairs(sieve.where(F.length("line") > WITHIN_JOIN - threshold), found, seen, threshold)).distinct()
        pairs = shared.stored(pairs, "line-pairs")
        seen = pairs if seen is None else seen.union(pairs)
        wanted = pairs.select("h1").union(pairs.select(F.col("o1").alias("h1"))).distinct()
        texts = members.join(wanted, "h1", "left_semi").groupBy("h1").agg(F.any_value("h2").alias("h2"), F.any_value("line").alias("line"))
        compared = pairs.join(texts, "h1").join(texts.select(F.col("h1").alias("o1"), F.col("line").alias("other")), "o1")
        later = shared.stored(compared.where(close(F.col("line"), F.col("other"), threshold)).select("h1", "h2").distinct(), "line-later")
        found = later if found is None else found.union(later)
        if not has["cut"]:
            return found.distinct()
        still = large.where(~sifted & (F.col("first") > F.col("earliest.first"))).join(found, ["h1", "h2"], "left_anti").select("key").distinct()
        still = shared.stored(still, "line-open")
        if still.isEmpty():
            return found.distinct()
        rest = F.col("rest").substr(F.col("head") + 1, F.length("rest") - F.col("head") - F.col("tail"))
        left = large.join(still, "key").join(found.distinct().withColumn("gone", F.lit(True)), ["h1", "h2"], "left")
        left = left.select("h1", "h2", "line", "bits", F.col("first").alias("place"), F.col("key").alias("group"), rest.alias("rest"), F.col("gone").isNull().alias("open"))
        carried = ("h1", "h2", "line", "bits", "place", "open", "rest")
        cut = _segments(left, "rest", threshold, *carried, group="group").select("h1", "h2", "line", "bits", "place", "open", "key", "role", _without(F.col("rest"), F.col("start"), F.col("size")).alias("rest"))
        # pairs of which one has no segments left: both are short
        few = left.where(F.length("rest") <= 2 * threshold + 1).select("h1", "h2", "line", "bits", "place", "open", F.xxhash64(F.lit("few"), "group").alias("key"), F.lit(3).alias("role"), "rest")
        cut = shared.stored(cut.union(few), "line-blocks")
        going_on = cut.groupBy("key").agg(F.min("place").alias("low"), F.max(F.when(F.col("open"), F.col("place"))).alias("high")).where("high > low").select("key")
        members = shared.stored(_members(cut.join(_crowded(cut), "key").join(going_on, "key", "left_semi")), "line-members")
        shared.remove(members.sparkSession, cut)


# ---------------------------------------------------------------- documents


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    own = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("print"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    blank = F.lit(False)
    for sign in BLANKS:  # trimming goes through all of a line, which few need
        blank = blank | F.startswith("line", F.lit(sign)) | F.endswith("line", F.lit(sign))
    own = own.withColumn("line", F.when(blank, F.btrim("line", F.lit(BLANKS))).otherwise(F.col("line"))).where("line != ''")
    return own.select(F.struct("doc", "print", "at").alias("place"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, print (of its text), gone (map of place / 64 to the bits of lines to remove), n_gone; documents that lose lines only."""
    lines = _occurrences(docs, id_col, text_col)
    near = near_lines(lines, threshold, least_chars)
    # numbers only, which are summed up without sorting; which of a document's lines is the first is asked of repeated ones
    repeated = lines.groupBy("h1", "h2").agg(F.min("place.doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    marks = repeated.select("h1", "h2", "first", "n", F.lit(False).alias("near")).union(near.select("h1", "h2", F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(True)))
    marks = shared.stored(marks.groupBy("h1", "h2").agg(F.max("first").alias("first"), F.max("near").alias("near"), F.max("n").alias("n")), "line-marks")
    hot = F.col("n") * HOT > int(marks.agg(F.sum("n")).first()[0] or 0)
    salted = marks.select("h1", "h2", "first", "near", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    placed = lines.select("h1", "h2", "place").join(F.broadcast(marks.where(hot).select("h1", "h2", F.lit(SALTS).alias("salts"))), ["h1", "h2"], "left")
    # by document, so that the first one's occurrences of a line are together
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("place.doc"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    least = F.min("place").over(Window.partitionBy("h1", "h2", "salt"))
    gone = placed.join(salted, ["h1", "h2", "salt"]).withColumn("least", least).where(F.col("near") | (F.col("place.doc") != F.col("first")) | (F.col("place") != F.col("least")))
    bits = gone.groupBy("place.doc", "place.print", F.floor(F.col("place.at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, place.at & 63))").alias("bits"))
    of_doc = bits.groupBy("doc", "print").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"), F.sum(F.bit_count("bits")).alias("n_gone"))
    return of_doc


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the text of what stays and two more columns, __n_lines (not blank) and __n_gone, in place of any of these names.

    Rows with a null id or text come back unchanged and have no part in others'. Repeated rows are one document: they
    lose the same lines. Equal places of rows with one id are told apart by their texts. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in ("__n_lines", "__n_gone")]
    doc, print_, gone, n_gone = shared.unused(docs.columns, "__doc", "__print", "__gone", "__count")
    found = removals(docs, id_col=id_col, text_col=text_col, threshold=threshold, least_chars=least_chars)
    found = found.select(F.col("doc").alias(doc), F.col("print").alias(print_), F.col("gone").alias(gone), F.col("n_gone").alias(n_gone))
    text, parts = F.col(text_col), F.split(F.col(text_col), "\n")
    joined = docs.select(*kept).join(found, (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(print_)), "left")
    bit = lambda k: F.call_function("shiftrightunsigned", F.coalesce(F.element_at(gone, F.shiftright(k, 6)), F.lit(0).cast("long")), k.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1))
    left = F.array_join(F.filter(parts, lambda _, k: bit(k) == 0), "\n")
    n_lines = F.coalesce(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(BLANKS)) != "")), F.lit(0))
    new = joined.withColumn("__n_lines", F.when(text.isNull(), 0).otherwise(n_lines)).withColumn("__n_gone", F.coalesce(n_gone, F.lit(0)).cast("int"))
    new = new.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(left))
    return new.select(*kept, "__n_lines", "__n_gone")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what line deduplication leaves of their texts; odd rows as dedup_lines() says, long texts whole."""
    found = dedup_lines(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_removed"), "text")
