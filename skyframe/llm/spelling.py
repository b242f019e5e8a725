"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges, level by level.

The trie. A word is filed twice, as it is and reversed, in the trie of its way and length, from the node of its first half on. A node is a prefix,
named by a hash; an edge leads from a node to the next node where its words part, so its label may be several code points, and an edge below which
one word is left leads to its end. Edges carry the word at an end and a mask of 64 bits of what follows their nodes in the words below.

The walk. If two words differ by one edit, they share the half before it or, read backwards, the half after it. So a word starts where its first
half ends, in the trie of its own length, where one replacement is allowed, and in that of the next, where one insertion is; a deletion is the other
word's insertion. A state is (word, position, node, edits); each level joins the states with the edges of their nodes, and states that reach an end
with one edit are pairs. A state that has its edit must find all its other code points, so it goes only where the edge's mask has their bit. Each
pair is confirmed by its edit distance, so that no collision of hashes makes one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.session import settle

LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
SLIP = 31
RATIO = 10


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                slip: int | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least `least_length` code points that occur `least_count` times or more in all texts.

    With `slip`, a run whose crc32 of '<id>:<run>' is divisible by it first loses the code point crc32 % length. Null texts have no words, a null id
    reads as empty, repeated rows count as often as they come, and no other column is read. Counts are added up inside tasks before they move.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    # a shorter run can't become a word; as the pattern is greedy, what it finds are whole runs
    found = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = found.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    if slip is None:
        words = runs.select(F.col("run").alias("word"))
    else:
        code = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
        placed = runs.select("run", code.alias("code")).withColumn("at", (F.col("code") % F.length("run")).cast("int"))
        cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
        words = placed.select(F.when(F.col("code") % slip == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _first_half(way: Column, size: Column) -> Column:
    """Code points before the allowed edits: half the length, rounded down forwards and up backwards, so that every edit has its way."""
    return F.shiftright(size + way, 1)


def _node(way: Column, size: Column, word: Column, depth: Column) -> Column:
    return F.xxhash64(way, size, F.substring(word, F.lit(1), depth))


def _bit(ending: Column) -> Column:
    """The place of an ending in a mask."""
    return F.pmod(F.xxhash64(ending), F.lit(64)).cast("int")


def _both_ways(words: DataFrame) -> DataFrame:
    """way (0 or 1), spelled (reversed on way 1), size, word, n."""
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("spelled")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("spelled")))
    return words.select("word", "n", F.length("word").alias("size"), F.explode(ways).alias("w")).select("w.way", "w.spelled", "size", "word", "n")


def _shared(a: Column, b: Column, size: Column) -> Column:
    """Length of the common prefix of two words of `size` code points, by halving."""
    steps = F.sequence(F.lit(1), F.length(F.bin(size.cast("long"))))
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"] + 1, 1)
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(state["low"]).alias("low"), F.when(same, state["high"]).otherwise(middle - 1).alias("high"))

    return F.aggregate(steps, start, halve)["low"]


def trie_edges(words: DataFrame) -> DataFrame:
    """The edge table of words (distinct word, n): node, label, child, ends, end_word, end_n; a child or an end_word. first: walks start here.

    All words below a node share what the smallest and the largest of them share, so one aggregation per (node, next code point) gives an edge with
    its whole label.
    """
    spelled = _both_ways(words)
    way, size = F.col("way"), F.col("size")
    depths = F.sequence(_first_half(way, size - 1), size - 1)
    paths = spelled.select("way", "size", "spelled", "word", "n", F.explode(depths).alias("depth"))
    paths = paths.select(_node(way, size, F.col("spelled"), F.col("depth")).alias("node"), F.substring("spelled", F.col("depth") + 1, F.lit(1)).alias("next"),
                         "depth", "way", "size", "spelled", "n", _bit(F.substring("spelled", F.col("depth") + 1, size)).alias("bit"))
    grouped = paths.groupBy("node", "next").agg(F.count("*").alias("below"), F.max("depth").alias("depth"), F.max("way").alias("way"), F.max("size").alias("size"),
                                                F.bit_or(F.expr("shiftleft(1L, bit)")).alias("ends"), F.max("n").alias("end_n"),
                                                F.min("spelled").alias("least"), F.max("spelled").alias("most"))
    alone = F.col("below") == 1
    reached = F.when(alone, size).otherwise(_shared(F.col("least"), F.col("most"), size))
    edges = grouped.withColumn("reached", reached)
    word = F.when(way == 1, F.reverse("least")).otherwise(F.col("least"))
    first = (F.col("depth") == _first_half(way, size)) | (F.col("depth") == _first_half(way, size - 1))
    return edges.select("node", F.substring("least", F.col("depth") + 1, F.col("reached") - F.col("depth")).alias("label"),
                        F.when(~alone, _node(way, size, F.col("least"), F.col("reached"))).alias("child"), "ends",
                        F.when(alone, word).alias("end_word"), F.when(alone, F.col("end_n")).alias("end_n"), first.alias("first"))


def _starts(words: DataFrame) -> DataFrame:
    """Two states per word and way: one to replace a code point among words of its length, one to insert a code point towards the next length."""
    way, size, target = F.col("way"), F.col("size"), F.col("target")
    states = _both_ways(words).select("*", F.explode(F.array(size, size + 1)).alias("target"))
    position = _first_half(way, size)
    return states.select("word", "n", "spelled", position.alias("position"), _node(way, target, F.col("spelled"), position).alias("node"),
                         F.lit(0).alias("edits"), (target > size).alias("grows"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States after one more edge, with the end's word where it has one: without an edit, or with the one that this edge needs."""
    here, m, fresh, grows = F.col("position"), F.length("label"), F.col("edits") == 0, F.col("grows")
    taken = F.when(grows, m - 1).otherwise(m)  # code points of the word that an edge with an edit takes
    room = F.length("spelled") - here

    def follows(after: Column) -> Column:
        ending = F.concat("label", F.substring("spelled", here + after + 1, F.length("spelled")))
        return F.call_function("getbit", F.col("ends"), _bit(ending)) == 1

    same = (m <= room) & (F.substring("spelled", here + 1, m) == F.col("label")) & F.when(fresh, F.col("child").isNotNull()).otherwise(follows(m))
    part = F.substring("spelled", here + 1, taken)
    # of two words that a replacement joins, the smaller one (in the code points that are left) finds the other
    edit = fresh & (taken <= room) & follows(taken) & (grows | (part < F.col("label"))) & (F.levenshtein(part, F.col("label"), 1) == 1)
    met = states.join(edges, "node").filter(same | edit)
    ways = F.when(same & edit, F.array(F.lit(0), F.lit(1))).when(same, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    moved = met.select("word", "n", "spelled", "grows", "child", "end_word", "end_n", F.explode(ways).alias("way"), here.alias("from"), m.alias("m"),
                       taken.alias("taken"), F.col("edits").alias("before"))
    position = F.col("from") + F.when(F.col("way") == 1, F.col("taken")).otherwise(F.col("m"))
    out = moved.select("word", "n", "spelled", position.alias("position"), F.col("child").alias("node"), (F.col("before") + F.col("way")).alias("edits"),
                       "grows", "end_word", "end_n")
    return out.filter(F.col("node").isNotNull() | (F.col("position") == F.length("spelled")))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: the pairs of words (distinct word, n) that differ by exactly one inserted, deleted or replaced code point, each once.

    The number of levels is that of the trie's forks along a word, few even for long words. Each level is a stage table, so a lost executor repeats
    one level. Both sides of its join are written first, so that Spark splits a node at which very many words stand.
    """
    known = settle(words.select("word", "n"))
    edges = settle(trie_edges(known))
    # below a first node, walks stand only where an edge leads
    inner = settle(edges.join(edges.select(F.col("child").alias("node")).filter(F.col("node").isNotNull()), "node", "left_semi").drop("first"))
    states, onward, ends = _starts(known), edges.filter("first").drop("first"), []
    while True:
        stepped = settle(_step(states, onward))
        ends.append(stepped.filter(F.col("node").isNull()).select("grows", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("end_word").alias("b"),
                                                                  F.col("end_n").alias("b_n")))
        states, onward = stepped.filter(F.col("node").isNotNull()).drop("end_word", "end_n"), inner
        if states.isEmpty():
            break
    found = reduce(DataFrame.union, ends).filter(F.levenshtein("a", "b", 1) == 1)
    # a replacement has one place and so one way and path; an insertion into a run of equal code points has several
    return found.filter("NOT grows").drop("grows").union(found.filter("grows").drop("grows").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that following forms leads to, for every row of forms (word, form). Forms must not run in a circle.

    Each round doubles the way that is followed, so a chain of f forms takes about log2(f) rounds.
    """
    links = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of words (distinct word, n): word, form, root, n, n_near, form_n.

    n_near: near words. form: the near word of largest n (ties: smallest in code-point order) if its n is at least `ratio` times the word's (2 or
    more, so that forms never run in a circle), else null. root: what following forms leads to, the word itself without a form. Null and empty words
    take no part; an empty table gives an empty result; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    counted = settle(words.select("word", F.col("n").cast("long").alias("n")).filter((F.length("word") > 0) & F.col("n").isNotNull()))
    pairs = settle(near_pairs(counted))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p"))
    numbers = both.groupBy(F.col("p.word").alias("word")).agg(F.count("*").alias("n_near"))
    strong = both.select("p.*").filter(F.col("near_n") >= ratio * F.col("n"))
    best = strong.groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    formed = settle(best.select("word", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")))
    told = counted.join(numbers, "word", "left").join(formed, "word", "left").join(roots(formed), "word", "left")
    return told.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
