"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. A word's reduced form and everything one edit away from it are joined with the
reduced forms of the vocabulary, and the pairs that meet are verified on the original strings. Reduced forms are short
numbers to compute: all replacements, deletions and insertions of a form follow from prefix sums of its symbols.

An edit leaves one half of a word as it was. For each length of the longer word, words meet under their first half and
under their second; only the other half is reduced and edited. So a word travels four times, its neighbourhood never
does, and a group is worked on by itself. The number of symbols is the least that gives a group four times more reduced
forms than words. A group with more words than fit a task is not gathered: its neighbourhoods over the whole alphabet
are rows, which Spark joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._tables import byte_views, cut_lineage, shuffle_width, small_batches, tidied

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST, LEAST = 5, 3
HELD = 200_000  # distinct words a task counts before it hands them on
TOGETHER = 30_000  # rows of whole groups worked on at once
GATHERED = 1 << 17  # rows of the largest group that a task gathers
ALPHABET = 90  # a-z and À-ÿ
ROOM = 4  # reduced forms to a word
CELLS = 1 << 18

Alter = Callable[[object, list[str]], list[str]]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, alter: Alter | None = None) -> DataFrame:
    """``word`` and ``n`` of the runs of letters (A-Z lower-cased) that have ``shortest`` code points and occur ``least`` times.

    A null text has none. ``alter(key, runs)`` may give other spellings for the distinct runs of a document.
    """
    small_batches(docs.sparkSession)

    def counted(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist() if alter is not None else [None] * batch.num_rows
            for name, raw in zip(keys, byte_views(batch.column(1))):
                if raw is None:
                    continue
                here = Counter(RUN.findall(raw.tobytes().lower().decode("utf-8", "replace")))
                words = list(here)
                for word, n in zip(words if alter is None else alter(name, words), here.values()):
                    if len(word) >= shortest:
                        counts[word] = counts.get(word, 0) + n
            if len(counts) >= HELD:
                yield counted(counts)
                counts = {}
        yield counted(counts)

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def meeting_places(words: DataFrame) -> DataFrame:
    """``place`` (hash of the rest), ``first`` (the first half stays), ``longer`` (length of the longer word), ``word``, ``n``: four rows a word."""
    long = F.char_length("word")
    rows = []
    for more in (0, 1):
        cut = F.floor((long + more) / 2).cast("int")
        for first in (True, False):
            kept = F.substring("word", F.lit(1), cut) if first else F.substring("word", cut + 1 - more, long)
            rows.append(F.struct(F.xxhash64(F.lit(first), long + more, kept).alias("place"), F.lit(first).alias("first"), (long + more).alias("longer")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("_at")).select("_at.*", "word", "n")


class Side:
    """Words of one length at meeting places of one kind: the edited halves as letters and as reduced forms."""

    def __init__(self, halves: list[str], places: np.ndarray, symbols: np.ndarray):
        self.many, self.long = len(halves), len(halves[0]) if halves else 0
        letters = np.array(halves, f"<U{max(1, self.long)}").view(np.uint32).reshape(self.many, max(1, self.long))[:, : self.long]
        self.letters, self.symbols = letters, symbols
        letter = np.where(letters < 0xC0, letters - 97, letters - 166).astype(np.uint64)
        some = symbols[:, None].astype(np.uint64)
        self.form = np.where(some >= ALPHABET, letter, (H.mix(letter + np.uint64(11)) >> np.uint64(32)) % some)
        self.up, self.down = H.powers(H.WORD_BASE, self.long + 2)[0], H.powers(H.WORD_BASE, self.long + 2)[1]
        self.sums = np.zeros((self.many, self.long + 1), np.uint64)
        np.cumsum((self.form + np.uint64(1)) * self.up[: self.long], axis=1, out=self.sums[:, 1:])
        self.place = H.mix(places.view(np.uint64))

    def named(self, rows: slice | np.ndarray, forms: np.ndarray) -> np.ndarray:
        return H.mix(forms + self.place[rows][:, None])

    def own(self) -> np.ndarray:
        return self.named(slice(None), self.sums[:, -1:])[:, 0]

    def replaced(self, rows: slice) -> Iterator[np.ndarray]:
        """The form itself and all forms with one symbol replaced; a symbol the row's alphabet lacks gives the form itself."""
        whole, form, some = self.sums[rows, -1:], self.form[rows], self.symbols[rows]
        yield self.named(rows, whole)
        for s in range(int(some.max())):
            step = np.where((some > s)[:, None], np.uint64(s) - form, np.uint64(0))
            yield self.named(rows, whole + step * self.up[: self.long])

    def deleted(self, rows: slice) -> np.ndarray:
        sums = self.sums[rows]
        return self.named(rows, sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * self.down[1])

    def inserted(self, rows: slice) -> Iterator[np.ndarray]:
        sums, some = self.sums[rows], self.symbols[rows]
        shifted = sums + (sums[:, -1:] - sums) * self.up[1]
        for s in range(int(some.max())):
            symbol = np.where(some > s, s + 1, 1).astype(np.uint64)[:, None]
            yield self.named(rows, shifted + symbol * self.up[: self.long + 1])

    def parts(self) -> Iterator[slice]:
        step = max(1, CELLS // (self.long + 1))
        for low in range(0, self.many, step):
            yield slice(low, min(self.many, low + step))


class Reduced:
    """The reduced vocabulary of a side, to be asked for forms."""

    def __init__(self, side: Side):
        self.order = np.argsort(side.own(), kind="stable")
        self.names = side.own()[self.order]

    def meet(self, rows: slice, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a word of the vocabulary that has one of the row's forms."""
        flat = asked.ravel()
        at = np.searchsorted(self.names, flat)
        hit = np.flatnonzero(self.names[np.minimum(at, len(self.names) - 1)] == flat) if len(self.names) else np.zeros(0, np.int64)
        low = at[hit]
        many = np.searchsorted(self.names, flat[hit], "right") - low
        owner = np.repeat(rows.start + hit // asked.shape[1], many)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return owner, self.order[np.repeat(low, many) + offset]


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    joined = np.unique(np.concatenate([a * width + b for a, b in pairs])) if pairs else np.zeros(0, np.int64)
    return joined // max(1, width), joined % max(1, width)


def _one_lacks(long: Side, short: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The half of ``j`` is that of ``i`` without one letter."""
    x, y = long.letters[i], short.letters[j]
    head = np.cumprod(x[:, :-1] == y, axis=1, dtype=np.uint8).sum(axis=1)
    tail = np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
    return head + tail >= short.long


def near_words(places: np.ndarray, first: bool, longer: int, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of places in ``words`` that are one edit apart, each found here or at the other kind of place, not at both.

    All words have ``longer`` letters or one less; ``places`` tells the groups.
    """
    cut = longer // 2
    _, group, size = np.unique(places, return_inverse=True, return_counts=True)
    edited = longer - cut if first else cut
    symbols = np.clip(np.ceil((ROOM * size) ** (1 / edited)), 2, ALPHABET).astype(np.int64)[group]
    length = np.fromiter(map(len, words), np.int64, len(words))
    big, small = np.flatnonzero(length == longer), np.flatnonzero(length < longer)
    if len(big) == 0:
        return big, big

    def half(i: int) -> str:
        word = words[i]
        return word[cut:] if first else word[: cut - (len(word) < longer)]

    def rest(i: int) -> str:
        word = words[i]
        return word[:cut] if first else word[cut - (len(word) < longer) :]

    long = Side([half(i) for i in big.tolist()], places[big], symbols[big])
    short = Side([half(i) for i in small.tolist()], places[small], symbols[small])
    long_forms, short_forms = Reduced(long), Reduced(short)
    same, less, more = [], [], []
    for rows in long.parts():
        i, j = _distinct([long_forms.meet(rows, asked) for asked in long.replaced(rows)], long.many)
        apart = (long.letters[i] != long.letters[j]).sum(axis=1) == 1
        same.append((big[i[apart]], big[j[apart]]))
        if short.many:
            i, j = _distinct([short_forms.meet(rows, long.deleted(rows))], short.many)
            fits = _one_lacks(long, short, i, j)
            less.append((i[fits], j[fits]))
    for rows in short.parts():
        j, i = _distinct([long_forms.meet(rows, asked) for asked in short.inserted(rows)], long.many)
        fits = _one_lacks(long, short, i, j)
        more.append((i[fits], j[fits]))
    out = list(same)
    for pairs, turned in ((less, False), (more, True)):
        for i, j in pairs:
            if first and len(i):  # a pair whose second halves agree too is found there
                before = np.fromiter((ord(words[w][cut - 1]) for w in big[i].tolist()), np.uint32, len(i))
                there = (long.letters[i][:, 1:] == short.letters[j]).all(axis=1) & (long.letters[i][:, 0] == before)
                i, j = i[~there], j[~there]
            out.append((small[j], big[i]) if turned else (big[i], small[j]))
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
    true = np.fromiter((rest(x) == rest(y) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))  # places are hashes
    return a[true], b[true]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and group its near words' number and the best of them, from rows sorted by place."""

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        place, first, longer, n = (table.column(c).to_numpy() for c in ("place", "first", "longer", "n"))
        words = table.column("word").to_pylist()
        kinds = longer.astype(np.int64) * 2 + first
        for kind in np.unique(kinds).tolist():
            rows = np.flatnonzero(kinds == kind)
            mine = [words[r] for r in rows.tolist()]
            a, b = near_words(place[rows], bool(kind & 1), kind >> 1, mine)
            if len(a) == 0:
                continue
            met, b = np.unique(b, return_inverse=True)
            rank = np.empty(len(met), np.int64)
            rank[sorted(range(len(met)), key=lambda m: mine[met[m]])] = np.arange(len(met))
            count = n[rows][met][b]
            order = np.lexsort((rank[b], -count, a))
            head = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
            many = np.bincount(a, minlength=len(mine))[a[head]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([mine[x] for x in a[head].tolist()], pa.string()), pa.array(many, pa.int64()), pa.array(count[head], pa.int64()),
                 pa.array([mine[x] for x in met[b[head]].tolist()], pa.string())],
                ["word", "near", "best_n", "best"],
            )

    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            place = table.column("place").to_numpy()
            whole = int(np.searchsorted(place, place[-1]))  # the last group may go on
            if whole:
                yield from solved(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                many = table.num_rows - whole
    if many:
        yield from solved(pa.Table.from_batches(held))


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's own form and the forms one edit away, over the whole alphabet, as rows."""
    for batch in batches:
        kinds = list(zip(batch.column("first").to_pylist(), batch.column("longer").to_pylist()))
        words, places = batch.column("word").to_pylist(), batch.column("place").to_numpy()
        for r, ((first, longer), word) in enumerate(zip(kinds, words)):
            cut, whole = longer // 2, len(word) == longer
            side = Side([word[cut:] if first else word[: cut - (not whole)]], places[r : r + 1], np.array([ALPHABET]))
            one = slice(0, 1)
            names = [*side.replaced(one), side.deleted(one)] if whole else side.inserted(one)
            asked = np.unique(np.concatenate([x.ravel() for x in names]).view(np.int64))
            form = np.concatenate([side.own().view(np.int64), asked])
            at = pa.array(np.full(len(form), r))
            columns = [batch.column(c).take(at) for c in ("first", "longer", "word", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(form), pa.array(np.arange(len(form)) > 0), *columns], ["form", "asks", "first", "longer", "word", "n"])


def _joined(crowded: DataFrame) -> DataFrame:
    """The same for places with too many words for a task; the pairs meet in a join of forms."""
    forms = cut_lineage(crowded.mapInArrow(tidied(_neighbourhoods), "form long, asks boolean, first boolean, longer int, word string, n long"))
    own = forms.where("not asks").select("form", "first", "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = forms.where("asks").join(own, ["form", "first", "longer"]).where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))

    def placed(word: str, letters: int) -> Column:
        return F.substring(word, F.floor(F.col("longer") / 2).cast("int") + letters, F.char_length(word))

    size = F.char_length("word") - F.char_length("other")
    elsewhere = F.when(size > 0, placed("word", 1) == placed("other", 0)).when(size < 0, placed("other", 1) == placed("word", 0)).otherwise(False)
    met = met.where(~F.col("first") | ~elsewhere).select("word", "other", "other_n").distinct()
    return met.groupBy("word").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("b")).select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.other").alias("best"))


def neighbours(words: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """``word``, ``near`` (number of words one inserted, deleted or replaced letter away), ``best_n`` and ``best`` (the near
    word with the largest ``n``, the smallest of them in code-point order). Words without near words are left out.

    ``words`` holds distinct ``word`` of two letters or more, of a-z and À-ÿ, and ``n``. Finding out whether a place
    has more than ``gathered`` rows is a job of its own.
    """
    rows = cut_lineage(meeting_places(words))
    sizes = rows.groupBy("place").agg(F.count(F.lit(1)).alias("many"))
    crowds = cut_lineage(sizes.where(F.col("many") > gathered).select("place"))
    parts = []
    if not crowds.isEmpty():
        parts.append(_joined(rows.join(crowds, "place", "left_semi")))
        rows = rows.join(crowds, "place", "left_anti")
    dealt = rows.repartition(shuffle_width(words), "place").sortWithinPartitions("place")
    parts.append(dealt.mapInArrow(tidied(_gathered), "word string, near long, best_n long, best string"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def _ends(steps: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word on the way from ``word`` over ``form``; the way doubles in each round."""
    ways = cut_lineage(steps.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = cut_lineage(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(words: DataFrame, times: int = 2, gathered: int = GATHERED) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each row of ``words`` (distinct ``word``, and ``n``).

    The form of a word is its best near word, if that is ``times`` as frequent, else null. Frequencies at least double on
    the way to the root, so the ways end, after as many rounds as the logarithm of the longest has bits.
    """
    words = cut_lineage(words.select("word", "n"))
    found = words.join(neighbours(words, gathered), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    found = cut_lineage(found.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = _ends(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
