"""Spelling variants: words one edit apart, by merging the light subtrees of tries.

Runs of letters are counted by Spark alone. Words that differ by one inserted, deleted or replaced code point agree before the
edit and after it, so they share the first or the last half of the shorter one. A group is a length, a prefix and a suffix:
words of that length, and of one more, that begin and end so and may differ between. Groups that hold too many words or letters
are split in the middle again, each word going to both halves, until what lies between is one letter, which bounds every group
by the square of the alphabet. So no group grows with the corpus, and no word is compared with all others.

Inside a group the middles go into a trie. At every node the child with the most words is heavy. Each light subtree is merged with
one character replaced (into the heavy one, and into the light ones merged so far) and with one character skipped (its own
first, or the heavy child's); ends that coincide are words one edit apart. Merging walks no further than both
subtrees go and shares what only one of them has, so a word is walked once for each light edge above it: their number is at most
the logarithm of the group's words. A pair is found at the node where its words part and nowhere else.

Null and empty texts have no words; a null id counts as an empty string in the checksum. Repeated rows count again. Of words
equally frequent the smallest in code-point order is the form. Words of any length are whole, and so are long texts. An empty table
gives no rows. Only the id and the text are read, so other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import mapped, store, whole_groups

#: Everything that is no letter of a run, once A-Z are lower-cased.
NO_LETTER = "[^a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and letters up to which a group is worked on as it is; a larger one is split while it has a middle to split.
GROUP_WORDS, GROUP_LETTERS = 4096, 1 << 19
#: Places of a trie node's parts.
CHILDREN, ENDS, SIZE = 0, 1, 2


def word_counts(docs: DataFrame, least_letters: int = 6, least_count: int = 5, every: int | None = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters that are long and frequent enough. Of the runs whose checksum with the document's id is a
    multiple of `every` one letter is deleted first (None: of no run)."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.split(F.translate(F.col(text_col), UPPER, LOWER), NO_LETTER)).alias("run"),
    ).where(F.char_length("run") >= least_letters)
    word = F.col("run")
    if every:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        word = F.when(h % every == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
        runs = runs.withColumn("at", at)
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each word's groups (short, before, after: the shorter length and the letters that are shared at both ends) split in the middle."""
    middle = F.col("short") - F.col("before") - F.col("after")
    half = F.floor(middle / 2).cast("int")
    both = F.array(
        F.struct((F.col("before") + half).alias("before"), F.col("after").alias("after")),
        F.struct(F.col("before").alias("before"), (F.col("after") + middle - half).alias("after")),
    )
    return rows.select("word", "n", "short", F.explode(both).alias("at")).select("word", "n", "short", "at.before", "at.after")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of each word's group, and its middle."""
    size = F.char_length("word")
    ends = F.concat(F.expr("substring(word, 1, before)"), F.expr("substring(word, char_length(word) - after + 1)"))
    return rows.withColumn("key", F.concat_ws(" ", "short", "before", "after", ends)).withColumn("middle", F.expr("substring(word, before + 1, char_length(word) - before - after)")).withColumn("letters", size - F.col("before") - F.col("after"))


def groups(words: DataFrame, most_words: int = GROUP_WORDS, most_letters: int = GROUP_LETTERS) -> DataFrame:
    """key, short, before, after, middle, word, n: the members of groups of two or more words, none of them too large.

    Groups are counted before their members are put together, and members meet the counts by a join, which Spark splits at a hot key.
    """
    size = F.char_length("word")
    least = F.lit(words.agg(F.min(size)).first()[0] or 0)  # no group of shorter words than there are
    now = _halves(words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short"), F.lit(0).alias("before"), F.lit(0).alias("after")).where(F.col("short") >= least))
    done = None
    while True:
        now = store(_keyed(now))
        sizes = now.groupBy("key").agg(F.count("*").alias("size"), F.sum("letters").alias("total"), F.min(F.col("short") - F.col("before") - F.col("after")).alias("left")).where("size > 1")
        large = ((F.col("size") > most_words) | (F.col("total") > most_letters)) & (F.col("left") > 1)
        members = store(now.join(sizes.select("key", large.alias("large")), "key"))
        ready = members.where("not large").drop("large", "letters")
        done = ready if done is None else done.unionByName(ready)
        rest = members.where("large")
        if rest.isEmpty():
            return done
        now = _halves(rest.select("word", "n", "short", "before", "after"))


def _node() -> tuple[dict, list, list]:
    return {}, [], [0]


def trie(words: list[str]) -> tuple:
    """Nodes of children, ends (places of the words that end here) and the number of words below."""
    root = _node()
    for i, word in enumerate(words):
        node = root
        node[SIZE][0] += 1
        for c in word:
            child = node[CHILDREN].get(c)
            if child is None:
                child = node[CHILDREN][c] = _node()
            node = child
            node[SIZE][0] += 1
        node[ENDS].append(i)
    return root


def _meet(x: tuple, y: tuple, but: str | None = None) -> Iterator[tuple[int, int]]:
    """Ends that coincide in two subtrees. `but`: a child of the second that is left out."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        for a in x[ENDS]:
            for b in y[ENDS]:
                yield a, b
        few, many = (x[CHILDREN], y[CHILDREN]) if len(x[CHILDREN]) <= len(y[CHILDREN]) else (y[CHILDREN], x[CHILDREN])
        for c in few:
            if c in many and c != but:
                stack.append((x[CHILDREN][c], y[CHILDREN][c]))
        but = None


def _merge(x: tuple, y: tuple, found: list[tuple[int, int]]) -> tuple:
    """A subtree with the ends of both; what only one has is shared, not copied. Ends that coincide are found."""
    top = _node()
    stack = [(x, y, top)]
    while stack:
        x, y, new = stack.pop()
        found += [(a, b) for a in x[ENDS] for b in y[ENDS]]
        new[ENDS].extend(x[ENDS] + y[ENDS])
        new[CHILDREN].update(x[CHILDREN])
        for c, child in y[CHILDREN].items():
            if c in x[CHILDREN]:
                new[CHILDREN][c] = both = _node()
                stack.append((x[CHILDREN][c], child, both))
            else:
                new[CHILDREN][c] = child
    return top


def one_edit_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of all pairs of distinct words that differ by one inserted, deleted or replaced character, each once."""
    stack = [trie(words)]
    while stack:
        node = stack.pop()
        children = node[CHILDREN]
        if not children:
            continue
        heavy = max(children, key=lambda c: children[c][SIZE][0])
        large = children[heavy]
        for a in node[ENDS]:
            for b in large[ENDS]:
                yield a, b
        others = None
        for c, light in children.items():
            if c == heavy:
                continue
            yield from _meet(light, large)  # c replaced by the heavy character
            if others is not None:  # c replaced by another light one
                found: list[tuple[int, int]] = []
                others = _merge(others, light, found)
                yield from found
            else:
                others = light
            yield from _meet(light, node, c)  # c skipped
            if c in large[CHILDREN]:  # the heavy character skipped
                yield from _meet(light, large[CHILDREN][c])
        stack.extend(children.values())


def near_words(words: DataFrame, most_words: int = GROUP_WORDS, most_letters: int = GROUP_LETTERS) -> DataFrame:
    """word, near, near_n: every word (word, n) with each word one edit away, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key"]):
            words, middles = table.column("word").to_pylist(), table.column("middle").to_pylist()
            n, inner = table.column("n").to_pylist(), table.column("inner").to_pylist()
            out: list[tuple[str, int, str, int]] = []
            for start, stop in zip(starts, [*starts[1:], len(words)]):
                for a, b in one_edit_pairs(middles[start:stop]):
                    a, b = int(start) + a, int(start) + b
                    # two of the longer words meet in the group of their own length
                    if len(middles[a]) == inner[a] or len(middles[b]) == inner[b]:
                        out += [(words[a], words[b], n[b]), (words[b], words[a], n[a])]
            for at in range(0, len(out), 1 << 16):
                columns = list(zip(*out[at : at + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["word", "near", "near_n"])

    rows = groups(words, most_words, most_letters).select("key", "middle", "word", "n", (F.col("short") - F.col("before") - F.col("after")).alias("inner"))
    return mapped(rows.repartition("key").sortWithinPartitions("key"), run, "word string, near string, near_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form), by jumps that double. A form is five times as frequent, so there are no circles and few rounds."""
    now = store(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = store(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): the most frequent near word where it is `times` as frequent."""
    words = store(words)
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    frequent = -F.col("best.n") >= times * F.col("n")
    rows = store(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")))
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of the frequent words of all texts."""
    return variants(word_counts(docs, id_col=id_col, text_col=text_col))
