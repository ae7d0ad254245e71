"""Missing or wrong document language labels (problem 10).

One Bloom filter for each language, bit-sliced: the filters share their hash functions, and slot i of one array holds bit i of
all of them, so the AND of a few slots is a bit mask of all languages that contain an n-gram. Counting the bits of the masks over
a stretch of text gives, for each language, the share of n-grams it contains; the share is corrected for the false positives
that the filter's fill implies. The largest corrected share decides.

Sentences are counted one by one. A text is cut where the language changes: of all ways to cut it into stretches of two
sentences or more, the one is taken whose sentences fit their stretch's language best, with a price for every change; so a
sentence or a few words quoted from another language make no stretch.

The filters are fitted on a bounded sample of labelled rows (`per_language` texts of each language, chosen by a hash). Labels may be
wrong: a text counts for a language only if the commonest function words of that language are the commonest in the text too;
after a first fit, the sample is cut into stretches and fitted again.

Defined results: null and blank texts, texts of symbols and texts without a sentence of these languages have no language and are
not among the rows. Equal shares go to the language named first. Very long texts are read whole. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes and names by which a label may name a language.
NAMES = {
    "en": ("en", "eng", "english"),
    "fi": ("fi", "fin", "finnish", "suomi"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "sw": ("sw", "swa", "swh", "swahili", "kiswahili"),
    "id": ("id", "ind", "in", "indonesian", "indonesia", "bahasa"),
}
LANGS = tuple(NAMES)
N = len(LANGS)
#: Common function words; they only vouch for the labels of the sample.
FUNCTION_WORDS = {
    "en": "the of and to in was that it for on with as his had at by not from this which but were are they",
    "fi": "ja on ei oli että hän se mutta kun joka ovat olivat kuin niin myös sitä jotta sillä tai koska kaikki sanoi",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an war dass",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero estaba",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce était",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao estava",
    "ru": "и в не на я быть он с что а по это она этот к но они мы из у за так же от было",
    "sw": "ya na wa kwa ni katika za la kuwa hii cha kama hiyo yake huo pia lakini alisema au mwa baada kabla",
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena tersebut ada oleh sebuah berada",
}
_FUNCTION = {code: frozenset(words.split()) for code, words in FUNCTION_WORDS.items()}

ORDERS = (3, 4, 5)
HASHES = 3
SLOTS = 1 << 20
#: A language contains an n-gram if the n-gram is at least this share as frequent in it as where it is most frequent.
FREQUENT = 0.2
#: Price of a change of language, in sentences that fit fully.
CHANGE = 0.3
#: A sentence with fewer n-grams than this counts less; under a quarter of it, not at all.
FULL_SENTENCE = 40

_SENTENCE_END = re.compile(r"[.!?…。？！]+[\"'”»’)\]]*(?=\s|$)|[\n\r]+|\s/\s")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: For each bit mask its bits, and whether there is any.
_BITS = np.concatenate([(np.arange(1 << N)[:, None] >> np.arange(N)[None, :]) & 1, np.arange(1 << N)[:, None] > 0], 1).astype(np.float64)
#: Pieces whose masks are tallied at once.
TALLIED = 4096
_ALPHA = np.array([chr(i).isalpha() for i in range(1 << 16)])


def label_code(label: str | None) -> str | None:
    """The language a label names, in any of its spellings; None if it names none of these."""
    if not label:
        return None
    parts = [p for p in re.split(r"[^\w]+|_", label.strip().lower()) if p]
    first = parts[0] if parts else ""
    return next((code for code, names in NAMES.items() if first in names), None)


def label_code_column(col: Column | str) -> Column:
    """The same as a Column."""
    col = F.col(col) if isinstance(col, str) else col
    names = F.create_map(*[F.lit(x) for code, spelled in NAMES.items() for name in spelled for x in (name, code)])
    return F.try_element_at(names, F.regexp_extract(F.lower(col), r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters in lower case, all else as single blanks, and the place in the text that each comes from."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case
        low = "".join(c.lower()[:1] for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _ALPHA[np.minimum(points, len(_ALPHA) - 1)]
    small = points < 128
    if (far := np.flatnonzero(points >= len(_ALPHA))).size:
        is_letter[far] = [chr(p).isalpha() for p in points[far].tolist()]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first blank after a letter stays
    if not small.all():
        keep &= is_letter | ~np.isin(points, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    at = np.nonzero(keep)[0]
    return np.where(is_letter[at], points[at], 32).astype(np.uint64), at


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """For each order, a 64-bit hash of the n-gram that starts at each place; a longer one goes on from the shorter."""
    out, h = [], np.full(len(points), 17, dtype=np.uint64)
    for k in range(ORDERS[-1]):
        n = max(0, len(points) - k)
        h = (h[:n] ^ points[k : k + n]) * _MULT
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            out.append(h)
    return out


class LanguageFilter:
    """The bit-sliced Bloom filters of all languages."""

    def __init__(self, texts: dict[str, list[str]]):
        every, per, totals = [], [], np.zeros(N)
        for i, code in enumerate(LANGS):
            grams = []
            for t in texts.get(code, []):
                points, _ = letters(t)
                grams += gram_hashes(points)
                totals[i] += len(points)
            seen, count = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, int))
            every.append(seen)
            per.append(count)
        grams = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        rate = np.zeros((len(grams), N))
        for i in range(N):
            if totals[i]:
                rate[np.searchsorted(grams, every[i]), i] = per[i] / totals[i]
        inside = (rate > 0) & (rate >= FREQUENT * rate.max(1, keepdims=True)) if len(grams) else rate.astype(bool)
        mask = (inside * (1 << np.arange(N))).sum(1).astype(np.uint16)
        self.slots = np.zeros(SLOTS, dtype=np.uint16)
        for k in range(HASHES):
            np.bitwise_or.at(self.slots, self._slot(grams, k), mask)
        fill = np.array([((self.slots >> i) & 1).mean() for i in range(N)])
        self.false_positive = fill**HASHES

    @staticmethod
    def _slot(hashes: np.ndarray, k: int) -> np.ndarray:
        """The k-th slot: the upper bits of the hash, k steps on by its middle bits."""
        slot = (hashes >> np.uint64(44)) + np.uint64(k) * ((hashes >> np.uint64(22)) | np.uint64(1))
        return (slot & np.uint64(SLOTS - 1)).astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the bit mask of the languages that contain it."""
        m = self.slots[self._slot(hashes, 0)]
        for k in range(1, HASHES):
            m = m & self.slots[self._slot(hashes, k)]
        return m

    def tally(self, texts: list[str], borders: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece of the texts, in order: for each language the n-grams it contains, less the false positives expected, and the
        number of n-grams that any language contains; and for each text the number of its letters with single blanks between.
        borders: where the pieces of each text end, the text's end among them; without, each text is one piece. An n-gram belongs
        to the piece it begins in and does not reach into another text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes + 1) - sizes - 1
        points, at = letters("\n".join(texts))
        starts, stops = np.searchsorted(at, first), np.searchsorted(at, first + sizes)
        if borders is None:
            ends, pieces = stops, np.ones(len(texts), np.int64)
        else:
            pieces = np.fromiter(map(len, borders), np.int64, len(texts))
            ends = np.searchsorted(at, np.repeat(first, pieces) + np.fromiter((x for b in borders for x in b), np.int64, pieces.sum()))
        begins = np.r_[0, ends[:-1]][: len(ends)]
        begins[np.cumsum(pieces)[pieces > 0] - pieces[pieces > 0]] = starts[pieces > 0]
        grams = gram_hashes(points)
        hits, known = np.zeros((len(ends), N)), np.zeros(len(ends))
        limit = np.repeat(stops, pieces)
        for i in range(0, len(ends), TALLIED):
            part = slice(i, min(i + TALLIED, len(ends)))
            counted = np.zeros((part.stop - i) << N)
            for order, h in zip(ORDERS, grams):
                last = np.maximum(np.minimum(ends[part], limit[part] - order + 1), begins[part])
                n = last - begins[part]
                place = np.repeat(begins[part] - (np.cumsum(n) - n), n)
                place += np.arange(len(place))
                counted += np.bincount(np.repeat(np.arange(len(n)) << N, n) + self.masks(h[place]), minlength=len(counted))
            bits = counted.reshape(-1, 1 << N) @ _BITS
            known[part] = bits[:, N]
            hits[part] = np.maximum((bits[:, :N] - bits[:, N:] * self.false_positive) / (1 - self.false_positive), 0)
        return hits, known, stops - starts

    def stretches(self, text: str) -> list[tuple[int, int, int, float]]:
        """The stretches of one text, as `all_stretches` gives them."""
        return self.all_stretches([text])[0]

    def all_stretches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text (start, end, language number, confidence) of each stretch in one language; none if it is in none of them.
        Confidence: the corrected share of the stretch's language, less half that of the next one, from 0 to 1."""
        texts, borders = [t or "" for t in texts], []
        for text in texts:
            ends = [m.end() for m in _SENTENCE_END.finditer(text)]
            if text and (not ends or ends[-1] < len(text)):
                ends.append(len(text))
            borders.append(ends)
        out, i = [], 0
        hits, known, points = self.tally(texts, borders)
        share = hits / np.maximum(known, 1)[:, None]
        weight = np.minimum(1.0, known / FULL_SENTENCE)
        fits = (weight >= 0.25) & (share.max(1, initial=0) >= 0.5)
        best = share.argmax(1)
        for ends, n in zip(borders, points.tolist()):
            part = slice(i, i + len(ends))
            i += len(ends)
            out.append(self._cut(ends, hits[part], known[part], share[part], np.where(fits[part], weight[part], 0.0), best[part], fits[part], n) if ends else [])
        return out

    @staticmethod
    def _cut(borders: list[int], hits: np.ndarray, known: np.ndarray, share: np.ndarray, weight: np.ndarray, best: np.ndarray, fits: np.ndarray, points: int) -> list[tuple[int, int, int, float]]:
        if not fits.any() or known.sum() < 0.5 * len(ORDERS) * max(1, points - 8):
            return []
        of = np.unique(best[fits])
        path = np.full(len(borders), of[0]) if len(of) == 1 or fits.sum() < 4 else cut(share - share.max(1, keepdims=True), weight)
        if len(of) > 1 and fits.sum() < 4:
            path[:] = (hits * (weight > 0)[:, None]).sum(0).argmax()
        out, start, first = [], 0, 0
        for i in [*(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]:
            total, n = hits[first:i].sum(0), max(known[first:i].sum(), 1)
            own = total[path[first]] / n
            total[path[first]] = 0
            out.append((start, borders[i - 1], int(path[first]), float(np.clip(own - total.max() / n / 2, 0, 1))))
            start, first = borders[i - 1], i
        return out

def cut(loss: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The language of each sentence: the best path on which every language holds for two counting sentences or more.
    loss: how much worse each language fits a sentence than the best one does (0 or less)."""
    n = len(loss)
    gain = loss * weight[:, None]
    counts = weight >= 0.5
    low = -1e18
    one, two = np.zeros(N), np.full(N, low)  # the present stretch has fewer than two counting sentences; two or more
    back: list[tuple[np.ndarray, np.ndarray]] = []  # where each state came from: 0 the same stretch short, 1 long, 2 + l: a change from l
    started = False
    for i in range(n):
        change = two.max() - CHANGE if two.max() > low / 2 else low
        source = int(two.argmax())
        if counts[i]:
            if not started:
                new_one, from_one = gain[i].copy(), np.zeros(N, dtype=int)
                new_two, from_two = np.full(N, low), np.zeros(N, dtype=int)
                started = True
            else:
                new_two = np.maximum(one, two) + gain[i]
                from_two = np.where(two >= one, 1, 0)
                new_one, from_one = np.full(N, change) + gain[i], np.full(N, 2 + source)
        else:
            new_one, from_one = one + gain[i], np.zeros(N, dtype=int)
            new_two, from_two = two + gain[i], np.ones(N, dtype=int)
        back.append((from_one, from_two))
        one, two = new_one, new_two
    state = 1 if two.max() > low / 2 else 0
    lang = int((two if state else one).argmax())
    path = np.zeros(n, dtype=int)
    for i in range(n - 1, -1, -1):
        path[i] = lang
        came = int(back[i][state][lang])
        if came >= 2:
            lang, state = came - 2, 1
        else:
            state = came
    return path


def vouched(text: str, code: str) -> bool:
    """Whether the function words of the language are the commonest in the text."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    found = {c: sum(w in known for w in words) for c, known in _FUNCTION.items()}
    most = max(found.values())
    return most > 0 and found[code] == most and found[code] >= 0.05 * len(words)


def fit_filter(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = 500, longest: int = 20_000) -> LanguageFilter:
    """Fit on at most 2 * per_language labelled texts of each language, each of at most `longest` characters; texts are chosen by a hash of themselves."""
    rows = labelled.select(F.col(text_col).alias("t"), label_code_column(label_col).alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 20) & (F.length("t") <= longest))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row for each language
    if not counts:
        return LanguageFilter({})
    part = F.lit(0.0)
    for code, n in counts.items():
        part = F.when(F.col("l") == code, min(1.0, 1.5 * per_language / n)).otherwise(part)
    drawn = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)
    texts: dict[str, list[str]] = {}
    for t, code in rows.where(drawn < part).distinct().limit(2 * per_language * N).collect():
        if len(texts.setdefault(code, [])) < 2 * per_language:
            texts[code].append(t)
    texts = {code: list(dict.fromkeys(x)) for code, x in texts.items()}
    good = {code: [t for t in x if vouched(t, code)] or x for code, x in texts.items()}
    first = LanguageFilter(good)
    again: dict[str, list[str]] = {}
    for code, x in texts.items():
        for part in chunks(x):
            for t, found in zip(x[part], first.all_stretches(x[part])):
                for start, end, lang, sure in found:
                    if sure > 0.3:
                        again.setdefault(LANGS[lang], []).append(t[start:end])
    return LanguageFilter({code: again.get(code) or good.get(code, []) for code in LANGS})


def language_stretches(df: DataFrame, fitted: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, seg_no, lang, confidence, first, last, label): one row numbered 0 for a text in one language, else one for each stretch from 1
    on; first and last are places in the text (from 0, the last not included), label is the code that the given label names."""
    kind = dict(df.dtypes)[id_col]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for part in chunks(b["__text"]):
                rows = b.iloc[part]
                for key, label, found in zip(rows[id_col], rows["__label"], fitted.all_stretches(rows["__text"].tolist())):
                    for n, (start, end, lang, sure) in enumerate(found):
                        out.append((key, n + 1 if len(found) > 1 else 0, LANGS[lang], sure, start, end, label))
            yield pd.DataFrame(out, columns=[id_col, "seg_no", "lang", "confidence", "first", "last", "label"])

    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"), label_code_column(label_col).alias("__label"))
    return rows.mapInPandas(find, f"`{id_col}` {kind}, seg_no INT, lang STRING, confidence DOUBLE, first INT, last INT, label STRING")


def chunks(texts: Iterable[str | None], room: int = 200_000) -> Iterator[slice]:
    """Slices of a batch whose texts have about `room` characters together, or that hold one text."""
    start = size = end = 0
    for end, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > room:
            yield slice(start, end)
            start, size = end, 0
        size += n + 1
    if size:
        yield slice(start, end + 1)


def label_cases(stretches: DataFrame) -> DataFrame:
    """The rows of language_stretches that a right label does not explain: several languages, or a label that names no or another language."""
    return stretches.where((F.col("seg_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("lang")))
