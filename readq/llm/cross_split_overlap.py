"""Same or near-same records across splits (problem 3).

The distinct normalised passages of the evaluation splits are cut into shards of bounded size, by length, and written once into
the shared folder. A word and the number of its occurrence in the text are a token, so texts are sets. A shard has a row of bits
for each token, one bit for each passage, and an Aho-Corasick automaton over the words whose tokens have a row of their own.
A task scans the words of all training texts it holds once with the automaton of every shard whose lengths fit, and adds up the
rows of the tokens of a text as binary numbers, 64 passages at a time: how many of these tokens each passage holds. Passages
that hold enough are compared exactly: the longest common subsequence of words must hold at least four fifths of the longer text.

Near texts of n words lose no more than n - ceil(0.8 n) tokens each; so of any n - ceil(0.8 n) + k tokens of a text, a passage near
it holds at least k. That filter is exact for any choice of tokens and any k: rare tokens are added up first, and k grows until few
passages are left. Rare tokens of a shard share rows, which lets more passages through and never fewer. So no pair is left out,
whatever was changed and however many copies of a passage there are.

The questions of passages that belong together are compared in the same way, after an exact prefix filter: two texts that keep
four fifths of their words share one of the first fifth (and one more) of their words in any fixed order. So neither records
nor questions are compared all with all, even inside one passage.

Defined results: rows with null ids, rows of other splits, and rows whose passage or question is null or holds no word are left
out. A repeated id counts once, with every text it came with. An empty table gives an empty result. Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.functions.text import code_name
from readq.llm.memo import Memo
from readq.session import fresh_path, materialise

KEPT = 0.8
#: So many tokens are asked for at first, and as many more as long as more than LEFT words of 64 passages have one that holds enough.
MET, LEFT = 8, 64
#: Training texts whose lengths differ by less than this factor are looked for together.
ALIKE = 1.05
#: Bytes of bits that are worked on at once, so that they stay in a core's cache.
AT_ONCE = 64_000
#: Bits of tokens looked up at once where passages are left.
LOOKED_UP = 2_000_000
#: Words of all passages of a shard, about, and bytes of its rows of bits; they bound the memory a shard takes.
SHARD_WORDS, ROW_BYTES = 3_000_000, 18_000_000
#: Words rarer than one in so many are not counted for the order of the prefix filter.
FREQUENT = 20_000
#: Lengths within a band differ by this factor. Styles of passages are told apart by so many parts of a character a word, up to the last.
BAND, STYLES, MOST_STYLES = 1.3, 20, 400
#: A task holds so many characters of training texts while the shards pass.
HELD_CHARS = 16_000_000


def common_words(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of two sequences of symbols or words, with one bit for each place of the first."""
    where: dict = {}
    bit = 1
    for x in a:
        where[x] = where.get(x, 0) | bit
        bit <<= 1
    full = bit - 1
    rest = full
    get = where.get
    for x in b:
        met = rest & get(x, 0)
        rest = ((rest + met) | (rest - met)) & full
    return len(a) - rest.bit_count()


def near(a: list[str], b: list[str]) -> bool:
    """Whether two texts keep four fifths of the longer one's words in their order."""
    longer = max(len(a), len(b))
    if not a or not b or min(len(a), len(b)) < KEPT * longer:
        return False
    return a == b or common_words(a, b) >= KEPT * longer


class Symbols(dict):
    """The symbol of each word: a code point drawn by a hash, the surrogates left out. Two words may share one, so what symbols find is
    compared again by words."""

    def __missing__(self, word: str) -> str:
        n = 256 + zlib.crc32(word.encode()) % 1_000_000
        self[word] = s = chr(n if n < 0xD800 else n + 0x800)
        return s

    def code(self, text: str) -> str:
        if len(self) > 500_000:
            self.clear()
        return "".join([self[w] for w in text.split(" ")])


def fewest(n: np.ndarray) -> np.ndarray:
    """Words that a text of n words must share at least with any text near it."""
    return np.ceil(KEPT * n - 1e-9).astype(np.int64)


def tokens(owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token) of the words of texts: token is a word with the number of its occurrence in the text, so that texts are sets of them."""
    key = np.sort(owner << 32 | word)
    at = np.arange(len(key))
    fresh = np.r_[True, key[1:] != key[:-1]][: len(key)]
    return key >> 32, key & (1 << 32) - 1 | at - np.maximum.accumulate(np.where(fresh, at, 0)) << 32


class Texts:
    """Texts with their words and tokens, in the order of their lengths; of lengths that differ by less than `alike` those of shorter words first."""

    def __init__(self, keys: list[bytes], texts: list[str], alike: float = 1):
        sizes = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        if alike > 1:
            self.band = np.floor(np.log(sizes) / math.log(alike) + 1e-9).astype(np.int64)
            order = np.lexsort((np.fromiter(map(len, texts), np.int64, len(texts)) / sizes, self.band))
            self.band = self.band[order]
        self.keys, self.texts, self.sizes = [keys[i] for i in order], [texts[i] for i in order], sizes[order]
        self.need = fewest(self.sizes)
        vocabulary: dict[str, int] = {}
        word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in self.texts for w in t.split(" ")), np.int64, sizes.sum())
        self.names = list(vocabulary)
        owner, token = tokens(np.repeat(np.arange(len(texts)), self.sizes), word)
        #: Different tokens, those of each text as places among them, the text of each, and the texts that hold a token.
        self.known, where, self.count = np.unique(token, return_inverse=True, return_counts=True)
        self.token, self.owner = where.astype(np.int32), owner.astype(np.int32)

    def drawn(self) -> np.ndarray:
        """A number drawn by a hash for each of the different tokens."""
        drawn = np.fromiter((zlib.crc32(w.encode()) for w in self.names), np.int64, len(self.names))
        return drawn[self.known & (1 << 32) - 1] + (self.known >> 32) * 2_654_435_761


class Held(Texts):
    """Training texts that are looked for in shards."""

    def __init__(self, keys: list[bytes], texts: list[str]):
        super().__init__(keys, texts, ALIKE)
        self.start = np.cumsum(self.sizes) - self.sizes
        #: The least and most words of the texts of about a text's length.
        starts = np.flatnonzero(np.r_[True, self.band[1:] != self.band[:-1]])
        many = np.diff(np.r_[starts, len(self.band)])
        self.least, self.most = (np.repeat(f.reduceat(self.sizes, starts), many) for f in (np.minimum, np.maximum))
        self.number = self.drawn()
        self.words = f" {' '.join(self.names)} "
        self.ends = np.cumsum(np.fromiter(map(len, self.names), np.int64, len(self.names)) + 1)


def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(carry, sum) of three bits, for all bits at once."""
    u = a ^ b
    carry = a & b
    carry |= u & c
    u ^= c
    return carry, u


def tally(planes: list[np.ndarray], rows: list[np.ndarray], most: int) -> None:
    """Add rows of bits to the binary numbers whose digits are the planes, lowest first; no number gets larger than `most`."""
    for place in range(most.bit_length()):
        if place == len(planes) and rows:
            planes.append(rows.pop())
        carried = []
        while len(rows) > 1:
            carry, planes[place] = add(planes[place], rows.pop(), rows.pop())
            carried.append(carry)
        if rows:
            carried.append(planes[place] & rows[0])
            planes[place] = planes[place] ^ rows.pop()
        rows = carried


def at_least(planes: list[np.ndarray], k: int) -> np.ndarray:
    """Bits of the numbers that are k or more."""
    if k >> len(planes):
        return np.zeros_like(planes[0])
    more, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for i in reversed(range(len(planes))):
        if k >> i & 1:
            equal &= planes[i]
        else:
            more |= equal & planes[i]
            equal &= ~planes[i]
    return more | equal


class Shard:
    """Some passages in the order of their lengths, rows of bits that say which of them hold a token, and the automaton over the words
    whose tokens have rows of their own."""

    def __init__(self, keys: list[bytes], texts: list[str]):
        all_ = Texts(keys, texts)
        self.keys, self.texts, self.sizes, self.need = all_.keys, all_.texts, all_.sizes, all_.need
        width = -(-len(texts) // 64)
        rows = max(64, ROW_BYTES // (8 * width))
        own = np.arange(len(all_.known)) if len(all_.known) < rows else np.sort(np.argsort(-all_.count, kind="stable")[: rows * 3 // 4])
        #: Tokens with a row of their own; the others share the rows behind these, and the last row is empty.
        self.known, self.shared = all_.known[own], max(1, rows - len(own)) if len(own) < len(all_.known) else 1
        drawn = all_.drawn()
        row = len(own) + drawn % self.shared
        row[own] = np.arange(len(own))
        self.rare = np.unique(np.delete(drawn, own))
        self.bits = np.zeros((len(own) + self.shared + 1, width), "<u8")
        place = row[all_.token] * (8 * width) + (all_.owner >> 3)
        np.bitwise_or.at(self.bits.view(np.uint8).ravel(), place, np.left_shift(1, all_.owner & 7).astype(np.uint8))
        #: Passages of a row, as far as 16 bits can tell.
        self.count = np.minimum(np.bitwise_count(self.bits).sum(axis=1), 65_534).astype(np.uint16)
        self.signs = [(all_.names[w], w) for w in np.unique(self.known & (1 << 32) - 1).tolist()]
        self.automaton = None

    def rows(self, held: Held) -> np.ndarray:
        """The row of each of the different tokens of the texts, whose words the automaton matches."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for name, w in self.signs:
                self.automaton.add_word(f" {name} ", w)
            self.automaton.make_automaton()
        found = np.array(list(self.automaton.iter(held.words)), np.int64).reshape(-1, 2)
        number = np.full(len(held.names), -1)
        number[np.searchsorted(held.ends, found[:, 0])] = found[:, 1]
        number = number[held.known & (1 << 32) - 1]
        key = np.where(number < 0, -1, held.known >> 32 << 32 | number)
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        there = np.minimum(np.searchsorted(self.rare, held.number), max(0, len(self.rare) - 1))
        there = self.rare[there] == held.number if len(self.rare) else np.zeros(len(there), bool)
        return np.where(self.known[at] == key, at, np.where(there, len(self.known) + held.number % self.shared, len(self.bits) - 1))

    def candidates(self, held: Held, first: int, last: int) -> Iterator[tuple[int, list[int]]]:
        """(text, passages) for the texts from first to last: every pair that may be near, as the passage holds enough tokens of the text."""
        row = self.rows(held)
        # Texts that have more tokens than they may lose which no passage holds are done.
        before = np.r_[0, np.cumsum(row[held.token[held.start[first] : held.start[last - 1] + held.sizes[last - 1]]] == len(self.bits) - 1)]
        at = held.start[first:last] - held.start[first]
        texts = first + np.flatnonzero(before[at + held.sizes[first:last]] - before[at] <= held.sizes[first:last] - held.need[first:last])
        # Of the passages, those that fit a text are left to right in words of 64.
        left = np.searchsorted(self.sizes, fewest(held.least[texts])) // 64
        right = -(-np.searchsorted(self.need, held.most[texts], "right") // 64)
        #: Sorts tokens by the passages that hold them.
        key = self.count[row].astype(np.int64) << 32 | row
        i = 0
        while i < len(texts):
            taken = right[i : i + AT_ONCE // 8] - left[i]
            n = max(1, int(np.searchsorted(taken * np.arange(1, len(taken) + 1), AT_ONCE // 8, "right")))
            if taken[n - 1] > 0:
                yield from self._of_some(held, key, texts[i : i + n], int(left[i]), int(right[i + n - 1]))
            i += n

    def _of_some(self, held: Held, key: np.ndarray, texts: np.ndarray, left: int, right: int) -> Iterator[tuple[int, list[int]]]:
        bits, need, empty = self.bits[:, left:right], int(fewest(held.least[texts[0]])), len(self.bits) - 1
        start, sizes = held.start[texts, None], held.sizes[texts, None]
        lost = sizes - held.need[texts, None]
        # The rows of each text's tokens, those of the fewest passages first.
        at = np.arange(int(sizes.max()))
        rows = key[held.token[np.minimum(start + at, len(held.token) - 1)]]
        rows[at >= sizes] = 1 << 62 | empty
        rows.sort(axis=1)
        rows &= (1 << 32) - 1
        planes = [np.zeros((len(texts), right - left), "<u8")]
        # Of as many tokens as a text may lose and `met` more, `met` must be there.
        added = met = 0
        while True:
            more = min(MET, need - met)
            if met:
                chosen = np.take_along_axis(rows, lost + met + np.arange(more), axis=1)
            else:
                at = np.arange(int(lost.max()) + more)
                chosen = np.where(at < lost + more, rows[:, : len(at)], empty)
            met += more
            chosen = chosen[:, (chosen != empty).any(axis=0)]
            for i in range(0, chosen.shape[1], 16):
                some = chosen[:, i : i + 16].T
                added += len(some)
                tally(planes, [bits[x] for x in some], added)
            enough = at_least(planes, met).ravel()
            words = np.flatnonzero(enough)
            if len(words) <= LEFT or met == need:
                break
        i, bit = np.nonzero(np.unpackbits(enough[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        text, passage = np.divmod(words[i], right - left)
        passage = (passage + left) * 64 + bit
        inside = passage < len(self.keys)
        text, passage = texts[text[inside]], passage[inside]
        columns = self.bits.view(np.uint8)
        for x in np.unique(text).tolist():
            n, c = int(held.sizes[x]), passage[text == x]
            c = c[(self.sizes[c] >= held.need[x]) & (self.need[c] <= n)]
            own, step = key[held.token[held.start[x] : held.start[x] + n], None] & (1 << 32) - 1, max(1, LOOKED_UP // n)
            kept: list[int] = []
            for j in range(0, len(c), step):
                some = c[j : j + step]
                shared = (columns[own, some >> 3] >> (some & 7).astype(np.uint8) & 1).sum(axis=0, dtype=np.int64)
                kept += some[shared >= np.maximum(held.need[x], self.need[some])].tolist()
            if kept:
                yield x, kept

    def same(self, c: int, text: str, coded: str, own: set[str], symbols: Symbols) -> bool:
        """Whether the text is the same as passage c, or nearly. coded, own: the text as symbols, and these as a set."""
        other = symbols.code(self.texts[c])
        longer = max(len(other), len(coded))
        # Words of the passage that the text lacks are lost for certain.
        if len(set(other) - own) > len(other) - KEPT * longer:
            return False
        return self.texts[c] == text or common_words(other, coded) >= KEPT * longer and near(self.texts[c].split(" "), text.split(" "))


#: One for one from ASCII: letters in lower case, digits, nothing for apostrophes, blanks for all else.
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() else None if chr(i) in "'`" else " ") for i in range(128)}
_HIDDEN = regex.compile(r"[\p{Cf}\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0'’‘`´]+")
_NO_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def plain_words(text: str | None) -> str:
    """Words in lower case between single blanks; characters that show nothing and apostrophes vanish, other marks separate."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.translate(_ASCII).split())
    return _NO_WORD.sub(" ", _HIDDEN.sub("", text.lower())).strip()


def split_role(col: str = "split"):
    """T for training, E for evaluation, null for anything else."""
    name = F.lower(F.trim(col))
    return F.when(name == "train", "T").when(name.isin("val", "test", "valid", "validation", "dev", "eval"), "E")


def read_records(df: DataFrame) -> DataFrame:
    """(rec, role, split, source, k, passage, question) with the texts as words. k: key of the passage, whose text is given
    with one or more of its records in each role. The texts are read once, and a text met again in a task is not worked on again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked, given = Memo(), Memo(), Memo(8 << 20)
        for batch in batches:
            role, passages, questions = (batch.column(i).to_pylist() for i in (1, 4, 5))
            k, texts, qs, keep = [], [], [], []
            for r, p, q in zip(role, passages, questions):
                text = None
                if p in keys:
                    key = keys[p]
                else:
                    text = plain_words(p)
                    keys[p] = key = hashlib.md5(text.encode()).digest() if text else None
                if q in asked:
                    question = asked[q]
                else:
                    asked[q] = question = plain_words(q)
                if key is None or not question:
                    keep.append(False)
                    continue
                keep.append(True)
                k.append(key)
                qs.append(question)
                fresh = (r, key) not in given
                texts.append((plain_words(p) if text is None else text) if fresh else None)
                if fresh:
                    given[r, key] = True
            rest = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(4)), pa.array(k, pa.binary()), pa.array(texts, pa.string()), pa.array(qs, pa.string())], ["rec", "role", "split", "source", "k", "passage", "question"])

    rows = df.select(F.col("rec_id").cast("bigint").alias("rec"), split_role().alias("role"), F.lower(F.trim("split")).alias("split"), code_name("source").alias("source"), F.col("passage").cast("string").alias("p"), F.col("question").cast("string").alias("q"))
    rows = rows.where("rec IS NOT NULL AND role IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL")
    return rows.mapInArrow(read, "rec BIGINT, role STRING, split STRING, source STRING, k BINARY, passage STRING, question STRING")


def passage_links(records: DataFrame) -> DataFrame:
    """(tk, ek): keys of a training and an evaluation passage that are the same or nearly so."""
    spark = records.sparkSession
    length = F.size(F.split("passage", " "))
    evals = records.where("role = 'E' AND passage IS NOT NULL").groupBy("k").agg(F.first("passage").alias("passage"))
    evals = evals.withColumn("n", length).withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    evals = materialise(evals.withColumn("style", F.least(F.floor(F.length("passage") * STYLES / F.col("n")), F.lit(MOST_STYLES)).cast("int")), "evals")
    # One row for each band and style; bands grow as the logarithm of the lengths.
    cells = evals.groupBy("band", "style").agg(F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most")).collect()
    if not cells:
        return spark.createDataFrame([], "tk BINARY, ek BINARY")
    shards: list[tuple[int, int, int]] = []  # number, least and most words
    parts: list[tuple[int, int, int, int]] = []  # band, style, first shard, shards
    for band, of_band in groupby(sorted(cells, key=lambda r: (r["band"], r["style"])), lambda r: r["band"]):
        # Styles of few words have one shard, one of many words has several.
        full = SHARD_WORDS
        for r in of_band:
            n = -(-r["words"] // SHARD_WORDS)
            if n > 1 or full + r["words"] > SHARD_WORDS:
                shards += [(len(shards) + i, r["least"], r["most"]) for i in range(n)]
                full = SHARD_WORDS if n > 1 else r["words"]
            else:
                number, least, most = shards[-1]
                shards[-1] = number, min(least, r["least"]), max(most, r["most"])
                full += r["words"]
            parts.append((band, r["style"], len(shards) - n, n))
    part = F.broadcast(spark.createDataFrame(parts, "band INT, style INT, first INT, parts INT"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard([bytes(k) for k in rows["k"]], rows["passage"].tolist())
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "content": [pickle.dumps(shard, protocol=5)]})

    path = fresh_path(spark, "shards")
    dealt = evals.join(part, ["band", "style"]).select("k", "passage", (F.col("first") + F.pmod(F.xxhash64("k"), F.col("parts"))).cast("int").alias("shard"))
    dealt.groupBy("shard").applyInPandas(build, "shard INT, content BINARY").write.partitionBy("shard").parquet(path)

    def load(number: int) -> Shard | None:
        fs, root = pafs.FileSystem.from_uri(path)
        for f in fs.get_file_info(pafs.FileSelector(f"{root}/shard={number}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                for value in pq.read_table(f.path, filesystem=fs, columns=["content"], partitioning=None).column(0):
                    return pickle.loads(value.as_buffer())
        return None

    def scan_held(texts: list[tuple[bytes, str]]) -> pa.RecordBatch:
        left, right = [], []
        symbols = Symbols()
        held = Held([k for k, _ in texts], [t for _, t in texts])
        for number, least, most in shards:
            first, last = np.searchsorted(held.sizes, KEPT * least - 1e-9), np.searchsorted(held.sizes, most / KEPT + 1e-9, "right")
            shard = load(number) if first < last else None
            if shard is None:
                continue
            for t, passages in shard.candidates(held, int(first), int(last)):
                coded = symbols.code(held.texts[t])
                own = set(coded)
                for c in passages:
                    if shard.same(c, held.texts[t], coded, own, symbols):
                        left.append(held.keys[t])
                        right.append(shard.keys[c])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["tk", "ek"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, str]] = []
        chars = 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((k, text))
                chars += len(text)
                if chars > HELD_CHARS:
                    yield scan_held(held)
                    held, chars = [], 0
        if held:
            yield scan_held(held)

    # A task loads the shards once for all texts it holds: as few tasks as there are cores, or as the memory asks for.
    train = records.where("role = 'T' AND passage IS NOT NULL").select("k", "passage")
    chars = train.agg(F.sum(F.length("passage"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-chars // HELD_CHARS))
    texts = train.repartition(tasks, "k").groupBy("k").agg(F.first("passage").alias("passage"))
    # A text is given to one shard scan only, so links are distinct.
    return materialise(texts.mapInArrow(scan, "tk BINARY, ek BINARY"), "links")


def prefix_words(questions: DataFrame) -> DataFrame:
    """(question, word): the first fifth (and one more) of the different words of each text, rare words first.

    Only words that make up a FREQUENT-th of all words or more have a count in the order, so the table of counts that is
    broadcast has at most FREQUENT rows; all others come before them, long ones first.
    """
    texts = materialise(questions.select("question").distinct(), "questions")
    each = texts.select("question", F.explode(F.array_distinct(F.split("question", " "))).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") >= max(2, -(-total // FREQUENT)))
    ranked = each.join(F.broadcast(frequent), "word", "left").groupBy("question").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("word")).alias("l"), "word"))).alias("ranked"))
    words = F.size(F.split("question", " "))
    first = F.slice("ranked", 1, F.floor(words * F.lit(1 - KEPT) + 1e-9).cast("int") + 1)
    return ranked.select("question", F.explode(first).alias("x")).select("question", "x.word")


def overlap_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, alike). records: rec, role, split, source, k, question, those whose passage has a near one on the other side; alike: tk, tq, ek,
    eq, the passages and questions of training and evaluation records that belong together, once for all copies."""
    records = materialise(read_records(df), "texts")
    links = passage_links(records)
    small = records.select("rec", "role", "split", "source", "k", "question")
    keys = links.select(F.col("tk").alias("k"), F.lit("T").alias("role")).union(links.select(F.col("ek").alias("k"), F.lit("E").alias("role"))).distinct()
    small = materialise(small.distinct().join(keys, ["k", "role"], "left_semi"), "records")
    questions = small.select("k", "role", "question").distinct()
    keyed = questions.join(prefix_words(questions), "question")
    t = links.join(keyed.where("role = 'T'").select(F.col("k").alias("tk"), F.col("question").alias("tq"), "word"), "tk")
    e = links.join(keyed.where("role = 'E'").select(F.col("k").alias("ek"), F.col("question").alias("eq"), "word"), "ek")
    n = lambda c: F.size(F.split(c, " "))
    met = t.join(e, ["tk", "ek", "word"]).where(F.least(n("tq"), n("eq")) >= KEPT * F.greatest(n("tq"), n("eq"))).select("tk", "ek", "tq", "eq").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Memo()
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for i, pair in enumerate(zip(b["tq"], b["eq"])):
                alike = known.get(pair)
                if alike is None:
                    known[pair] = alike = near(pair[0].split(" "), pair[1].split(" "))
                keep[i] = alike
            yield b[keep]

    return small, met.mapInPandas(compare, "tk BINARY, ek BINARY, tq STRING, eq STRING")


def overlapping_records(df: DataFrame) -> DataFrame:
    """(train_id, eval_id, eval_split, eval_source, same_source): every pair of a training and an evaluation record with the same or nearly
    the same passage and question."""
    small, alike = overlap_classes(df)
    train = small.where("role = 'T'").select(F.col("k").alias("tk"), F.col("question").alias("tq"), F.col("rec").alias("train_id"), F.col("source").alias("train_source"))
    evals = small.where("role = 'E'").select(F.col("k").alias("ek"), F.col("question").alias("eq"), F.col("rec").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    pairs = alike.join(train, ["tk", "tq"]).join(evals, ["ek", "eq"])
    return pairs.select("train_id", "eval_id", "eval_split", "eval_source", F.col("train_source").eqNullSafe(F.col("eval_source")).alias("same_source")).dropDuplicates(["train_id", "eval_id"])


def overlap_report(df: DataFrame) -> DataFrame:
    """For each evaluation split and source: its records, those found in the training split, the pairs, and the pairs under another source.

    Pairs are counted from the numbers of copies on both sides, never written out; a record that came with several texts counts in the
    pairs of each."""
    small, alike = overlap_classes(df)
    copies = small.where("role = 'T'").groupBy(F.col("k").alias("tk"), F.col("question").alias("tq"), F.col("source").alias("ts")).agg(F.countDistinct("rec").alias("n"))
    met = materialise(alike.join(copies, ["tk", "tq"]).groupBy("ek", "eq", "ts").agg(F.sum("n").alias("n")), "met")
    found = small.where("role = 'E'").groupBy(F.col("k").alias("ek"), F.col("question").alias("eq"), "split", "source").agg(F.countDistinct("rec").alias("m"))
    found = found.join(met.groupBy("ek", "eq").agg(F.sum("n").alias("total")), ["ek", "eq"])
    same = met.select(F.col("ek").alias("ek2"), F.col("eq").alias("eq2"), "ts", F.col("n").alias("same"))
    found = found.join(same, (F.col("ek") == F.col("ek2")) & (F.col("eq") == F.col("eq2")) & F.col("source").eqNullSafe(F.col("ts")), "left")
    pairs = found.groupBy("split", "source").agg(F.sum(F.col("m") * F.col("total")).alias("pairs"), F.sum(F.col("m") * (F.col("total") - F.coalesce("same", F.lit(0)))).alias("other_source"))
    hit = small.where("role = 'E'").select("rec", "split", "source", F.col("k").alias("ek"), F.col("question").alias("eq")).join(met.select("ek", "eq").distinct(), ["ek", "eq"], "left_semi")
    hit = hit.groupBy("split", "source").agg(F.countDistinct("rec").alias("overlapping"))
    records = df.where(F.col("rec_id").isNotNull() & (split_role() == "E")).select("rec_id", F.lower(F.trim("split")).alias("split"), code_name("source").alias("source")).groupBy("rec_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    # One row for each split and source in each of the three: absent ones count 0, null sources are a source.
    parts = [t.select("split", "source", *[(F.col(c) if c in t.columns else F.lit(0)).cast("bigint").alias(c) for c in ("records", "overlapping", "pairs", "other_source")]) for t in (records.groupBy("split", "source").agg(F.count("*").alias("records")), hit, pairs)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split", "source").agg(*[F.sum(c).alias(c) for c in ("records", "overlapping", "pairs", "other_source")])
