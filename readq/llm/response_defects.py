"""Broken prompt and response pairs (problem 6).

A response is cut into clauses, and a linear-chain conditional random field tags every clause as answer, refusal, echo, foreign or
unfinished. Its features are: how much of the clause repeats the question and how much of the question the response repeats;
how much its words speak for a refusal or against one; whether it is quoted; which language the clause is in by the bit-sliced
filters of `language_id`, against the question's; and how the response ends, above all whether it breaks off inside a sentence of
the passage. The words under each tag are added up, and the coverage decides about the pair.

The field is trained here, on examples made from a bounded sample of the table itself (the SAMPLE pairs of lowest hash whose passage
has at most LONGEST characters): whole sentences and spans of the passages as answers, the same broken off, questions repeated
or reused, sentences of other languages, and the phrases of REFUSALS, next to what characters of stories say with the same words.
What a word speaks for is learned from these examples (`Cues`), not listed; the phrases are dealt into PARTS, and the field sees those of one part with the
words learned from the other parts, so that it trusts words no more than they deserve in phrases never met.

How words end clauses is counted on all different passages of the table; the words that make up a FREQUENT-th of all words or more are
kept, so at most FREQUENT of them go to the driver and into the model.

Defined results: a pair without question (null or blank) is not judged. A response that is null, holds no letter or digit, or is a
placeholder is `empty`. Otherwise, in this order: `copy`, `refusal`, `language`, `truncated`. Repeated rows of a pair
give its defect once. Very long responses are tagged whole. Responses of names and numbers alone are in no language.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.llm.language_id import LANGS, LanguageFilter, chunks, fit_filter
from readq.llm.memo import Memo
from readq.session import materialise

#: Pairs of the table from which the field's examples are made, and the longest passage, in characters, of such a pair.
SAMPLE, LONGEST = 1000, 20_000
#: The phrases are dealt into so many parts.
PARTS = 4
#: Words rarer than one in so many have no count of how they end clauses.
FREQUENT = 200_000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(len(TAGS))
#: Strings that stand for no answer, besides those without letters and digits; and those that do so in brackets.
PLACEHOLDERS = frozenset(("n/a", "n.a.", "na", "n a", "null", "nan", "tbd", "tba", "undefined", "n.a", "#n/a", "no answer", "no answer given"))
BRACKETED = frozenset(("blank", "empty", "none", "nil", "missing", "unknown", "no answer", "no response", "no text", "not available", "not applicable", "not given", "unanswered", "answer missing", "answer"))

#: Openings, statements and closings of refusals, of the same meanings in every language; a refusal has a statement and may have the others.
REFUSALS = {
    "en": (("I'm sorry, but", "Unfortunately,", "Sorry,", "I regret, but", "As an AI assistant,", "I apologize, but"), ("I cannot answer this question", "I can't help with that", "I am unable to provide an answer to this request", "it is not possible for me to answer", "I do not have enough information to answer", "I'm not allowed to discuss this topic", "the model is unable to answer", "the assistant cannot help with this"), ("Please ask something else.", "Is there anything else I can do?", "because no text was given.")),
    "fi": (("Olen pahoillani, mutta", "Valitettavasti", "Anteeksi,", "Pahoittelen, mutta"), ("en voi vastata tähän kysymykseen", "en pysty auttamaan tässä asiassa", "en voi antaa vastausta tähän pyyntöön", "minun ei ole mahdollista vastata", "minulla ei ole tarpeeksi tietoa vastaamiseen", "en saa puhua tästä aiheesta"), ("Kysy jotain muuta.", "Voinko auttaa jossain muussa?", "koska tekstiä ei annettu.")),
    "de": (("Es tut mir leid, aber", "Leider", "Entschuldigung,", "Ich bedaure, aber"), ("ich kann diese Frage nicht beantworten", "dabei kann ich nicht helfen", "auf diese Anfrage kann ich keine Antwort geben", "es ist mir nicht möglich zu antworten", "ich habe nicht genug Informationen für eine Antwort", "ich darf nicht über dieses Thema sprechen"), ("Bitte frag etwas anderes.", "Kann ich sonst noch helfen?", "weil kein Text angegeben wurde.")),
    "es": (("Lo siento, pero", "Por desgracia,", "Disculpa,", "Lamento que"), ("no puedo responder a esta pregunta", "no puedo ayudar con eso", "no puedo dar una respuesta a esta petición", "no me es posible responder", "no tengo suficiente información para responder", "no se me permite hablar de este tema"), ("Pregunta otra cosa.", "¿Puedo ayudar en algo más?", "porque no se dio ningún texto.")),
    "fr": (("Je suis désolé, mais", "Malheureusement,", "Désolé,", "Je regrette, mais"), ("je ne peux pas répondre à cette question", "je ne peux pas vous aider", "je ne peux pas donner de réponse à cette demande", "il ne m'est pas possible de répondre", "je n'ai pas assez d'informations pour répondre", "je ne suis pas autorisé à parler de ce sujet"), ("Posez une autre question.", "Puis-je vous aider pour autre chose ?", "car aucun texte n'a été donné.")),
    "pt": (("Sinto muito, mas", "Infelizmente,", "Desculpe,", "Lamento, mas"), ("não posso responder a esta pergunta", "não posso ajudar com isso", "não posso dar uma resposta a este pedido", "não me é possível responder", "não tenho informações suficientes para responder", "não tenho permissão para falar deste assunto"), ("Pergunte outra coisa.", "Posso ajudar em mais alguma coisa?", "porque nenhum texto foi dado.")),
    "ru": (("Мне жаль, но", "К сожалению,", "Извините,", "Сожалею, но"), ("я не могу ответить на этот вопрос", "я не могу с этим помочь", "я не могу дать ответ на этот запрос", "у меня нет возможности ответить", "у меня недостаточно информации для ответа", "мне нельзя говорить на эту тему"), ("Спросите что-нибудь другое.", "Могу ли я помочь чем-то ещё?", "так как текст не был дан.")),
    "sw": (("Nasikitika, lakini", "Kwa bahati mbaya", "Samahani,", "Pole,"), ("siwezi kujibu swali hili", "siwezi kusaidia katika jambo hilo", "siwezi kutoa jibu kwa ombi hili", "haiwezekani kwangu kujibu", "sina taarifa za kutosha kujibu", "siruhusiwi kuzungumza kuhusu jambo hili"), ("Tafadhali uliza swali lingine.", "Je, naweza kusaidia na jambo lingine?", "kwa sababu maandishi hayakutolewa.")),
    "id": (("Saya menyesal, tetapi", "Sayangnya,", "Maaf,", "Mohon maaf, tetapi"), ("saya tidak dapat menjawab pertanyaan ini", "saya tidak bisa membantu dengan hal itu", "saya tidak dapat memberikan jawaban untuk permintaan ini", "tidak mungkin bagi saya untuk menjawab", "saya tidak memiliki cukup informasi untuk menjawab", "saya tidak diizinkan membahas topik ini"), ("Silakan tanyakan hal lain.", "Ada lagi yang bisa saya bantu?", "karena teks tidak diberikan.")),
}
#: What characters of stories say and do with the same words, of the same meanings in every language.
STORY = {
    "en": ("{n} refused to help them.", "{n} could not answer the question.", "{n} was sorry that nobody could help.", "{n} was unable to help the others.", "because {n} could not answer", "but told nobody about it", "\"I cannot help you,\" {n} answered.", "Nobody knows.", "{n} said it was not possible.", "No."),
    "fi": ("{n} kieltäytyi auttamasta heitä.", "{n} ei voinut vastata kysymykseen.", "{n} oli pahoillaan, ettei kukaan voinut auttaa.", "{n} ei pystynyt auttamaan muita.", "koska {n} ei osannut vastata", "mutta ei puhunut siitä kenellekään", "\"En voi auttaa sinua\", {n} vastasi.", "Kukaan ei tiedä.", "{n} sanoi, ettei se ole mahdollista.", "Ei."),
    "de": ("{n} weigerte sich, ihnen zu helfen.", "{n} konnte die Frage nicht beantworten.", "{n} bedauerte, dass niemand helfen konnte.", "{n} war nicht imstande, den anderen zu helfen.", "weil {n} nicht antworten konnte", "aber sprach mit niemandem darüber", "\"Ich kann dir nicht helfen\", antwortete {n}.", "Niemand weiß es.", "{n} sagte, es sei nicht möglich.", "Nein."),
    "es": ("{n} se negó a ayudarles.", "{n} no pudo responder a la pregunta.", "{n} lamentó que nadie pudiera ayudar.", "{n} no fue capaz de ayudar a los demás.", "porque {n} no supo responder", "pero no habló de ello con nadie", "\"No puedo ayudarte\", respondió {n}.", "Nadie lo sabe.", "{n} dijo que no era posible.", "No."),
    "fr": ("{n} refusa de les aider.", "{n} ne pouvait pas répondre à la question.", "{n} regrettait que personne ne puisse aider.", "{n} fut incapable d'aider les autres.", "parce que {n} ne savait pas répondre", "mais n'en parla à personne", "\"Je ne peux pas t'aider\", répondit {n}.", "Personne ne le sait.", "{n} dit que ce n'était pas possible.", "Non."),
    "pt": ("{n} recusou-se a ajudá-los.", "{n} não conseguiu responder à pergunta.", "{n} lamentou que ninguém pudesse ajudar.", "{n} não foi capaz de ajudar os outros.", "porque {n} não soube responder", "mas não falou disso com ninguém", "\"Não posso ajudar-te\", respondeu {n}.", "Ninguém sabe.", "{n} disse que não era possível.", "Não."),
    "ru": ("{n} не хотела им помогать.", "{n} не могла ответить на вопрос.", "{n} жалела, что никто не мог помочь.", "{n} была не в силах помочь другим.", "потому что {n} не знала ответа", "но никому об этом не говорила", "\"Я не могу тебе помочь\", ответила {n}.", "Никто не знает.", "{n} сказала, что это невозможно.", "Нет."),
    "sw": ("{n} alikataa kuwasaidia.", "{n} hakuweza kujibu swali.", "{n} alisikitika kwamba hakuna aliyeweza kusaidia.", "{n} hakuweza kuwasaidia wengine.", "kwa sababu {n} hakujua jibu", "lakini hakuzungumza na yeyote kuhusu hilo", "\"Siwezi kukusaidia\", {n} alijibu.", "Hakuna anayejua.", "{n} alisema haiwezekani.", "Hapana."),
    "id": ("{n} menolak membantu mereka.", "{n} tidak dapat menjawab pertanyaan itu.", "{n} menyesal karena tidak ada yang bisa membantu.", "{n} tidak mampu membantu yang lain.", "karena {n} tidak tahu jawabannya", "tetapi tidak berbicara tentang itu dengan siapa pun", "\"Saya tidak bisa membantumu\", jawab {n}.", "Tidak ada yang tahu.", "{n} berkata itu tidak mungkin.", "Tidak."),
}

_HIDDEN = re.compile("[­​-‏⁠-⁯﻿]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"(?<=[.!?…;:。])[\"'”»’)\]]*\s+|(?<=,)\s+|[\r\n]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»’)\]]*\s+|[\r\n]+")
#: Where clauses of a text end, blanks following every line break.
_STOP = re.compile(r"[.!?…;:。,\r\n]+[\"'”»’)\]]*(?!\S)")
#: Words of ASCII texts are found without a pattern: blanks for all but letters, digits and apostrophes, after those outside of words are gone.
_PLAIN = {i: chr(i) if chr(i).isalnum() or i == 39 else " " for i in range(128)}
_LOOSE = re.compile(r"(?<![^\W_])'|'(?![^\W_])")
_FEATURES = 31


def clean(text: str) -> str:
    return text.strip() if text.isascii() else _HIDDEN.sub("", text).replace("’", "'").strip()


def split_words(text: str) -> list[str]:
    if text.isascii():
        return (_LOOSE.sub(" ", text) if "'" in text else text).translate(_PLAIN).split()
    return _WORD.findall(text)


def words(text: str) -> list[str]:
    return split_words(text.lower())


def last_words(text: str) -> Iterator[str]:
    """The last word of each clause."""
    text, at = text.replace("\n", "\n ") + "\n", 0
    for m in _STOP.finditer(text):
        if found := _WORD.findall(text, max(at, text.rfind(" ", at, m.start() - 1)), m.start()):
            yield found[-1]
        at = m.end()


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = clean(answer)
    low = text.lower().strip(" \"'.")
    inner = low.strip("<>[](){}*- ")
    return not any(c.isalnum() for c in text) or low in PLACEHOLDERS or inner in PLACEHOLDERS or (inner != low and inner in BRACKETED)


class Cues:
    """How much a word of one language speaks for one kind of text against another: the logarithm of how much likelier it is there. A word
    that neither holds is known by its first five letters, at half the weight, as most of these languages inflect."""

    def __init__(self, here: Iterable[str] = (), there: Iterable[str] = ()):
        a, b = (Counter(w for t in texts for w in words(clean(t))) for texts in (here, there))
        stems = [Counter(), Counter()]
        for c, stem in zip((a, b), stems):
            for w, n in c.items():
                stem[w[:5]] += n
        self.whole = self._weights(a, b)
        self.stem = {w: x / 2 for w, x in self._weights(*stems).items() if x > 0}

    @staticmethod
    def _weights(a: Counter, b: Counter) -> dict[str, float]:
        n, m = sum(a.values()) + 10, sum(b.values()) + 10
        # What was met in the other kind alone speaks for nothing at best, however few texts of the first kind there were.
        return {w: float(np.clip(np.log((a[w] + 0.1) / n * m / (b[w] + 0.1)), -4, 4 if w in a else 0)) for w in {**a, **b}}

    def of(self, ws: list[str]) -> list[float]:
        whole, stem = self.whole, self.stem
        return [whole[w] if w in whole else stem.get(w[:5], 0.0) for w in ws]


class Setting:
    """What the features need besides the pair: the language filters, how often words end a sentence or a clause, and what words speak for."""

    def __init__(self, filters: LanguageFilter, totals: list[tuple[str, int, int]]):
        self.filters = filters
        self.ends = {w: float(np.log((final + 0.2) / (n - final + 0.6))) for w, n, final in totals}
        self.cues, self.tales = ([Cues() for _ in LANGS] for _ in range(2))

    def learn(self, passages: dict[str, list[str]], refusals: dict, stories: dict, without: int | None = None) -> None:
        """Learn the words of refusals, against passages and stories, and of stories, against refusals, in each language. without: leave out
        the phrases of this part."""
        for i, code in enumerate(LANGS):
            said, told = ([p for k, p in enumerate(phrases) if without is None or k % PARTS != without] for phrases in ([p for part in refusals[code] for p in deal(part)], deal(stories[code])))
            told = [t.replace("{n}", "") for t in told if t]
            self.cues[i], self.tales[i] = Cues(filter(None, said), passages.get(code, []) + told), Cues(told, filter(None, said))

    def own_languages(self, questions: list[str], passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language, known): each question's language, and its number of n-grams known; if its words leave the language open, the passage's
        words count as well."""
        hits, known, _ = self.filters.tally(questions)
        top = np.sort(hits, 1)
        open_ = np.flatnonzero((top[:, -1] - top[:, -2] < 0.2 * np.maximum(known, 1)) & np.fromiter(map(bool, passages), bool, len(passages)))
        if len(open_):
            different = list(dict.fromkeys(passages[i] for i in open_))
            more, n, _ = self.filters.tally(different)
            at = {p: i for i, p in enumerate(different)}
            at = [at[passages[i]] for i in open_]
            hits[open_] = hits[open_] / np.maximum(known[open_], 1)[:, None] + 0.5 * more[at] / np.maximum(n[at], 1)[:, None]
        return hits.argmax(1), known

    def features(self, rows: list[tuple[str, str, str | None]], memo: Memo) -> list[tuple[list[int], np.ndarray, float]]:
        """For each (question, answer, passage): of each clause its number of words and its features; and the share of the question's
        words that the answer holds in order. memo: what is known of passages met before."""
        rows = [(clean(q), clean(a), clean(p or "")) for q, a, p in rows]
        cut = [[c for c in _CLAUSE.split(a) if any(map(str.isalnum, c))] for _, a, _ in rows]
        own, q_known = self.own_languages([q for q, _, _ in rows], [p for _, _, p in rows])
        hits, known, _ = self.filters.tally([c for clauses in cut for c in clauses])
        n_own = np.repeat(own, np.fromiter(map(len, cut), np.int64, len(cut)))
        spoken = np.where(known >= 8, hits.argmax(1), n_own).tolist()
        gaps = ((hits.max(1, initial=0) - hits[np.arange(len(n_own)), n_own]) / np.maximum(known, 1.0)).tolist()
        known = known.tolist()
        flat, sizes, repeated, at = [], [], [], 0
        for (question, answer, passage), clauses, q_n in zip(rows, cut, q_known.tolist()):
            seen = memo.get(passage)
            if seen is None:
                shown, low = split_words(passage), words(passage)
                if len(shown) != len(low):  # a few letters are no letters in lower case
                    low = [w.lower() for w in shown]
                memo[passage] = seen = (frozenset(a for a, w in zip(low, shown) if w[0].isupper()), f" {' '.join(low)} ")
            names, body = seen
            names = names.union(w.lower() for w in split_words(question) if w[0].isupper())
            qw, aw = words(question), words(answer)
            in_order = common(qw, aw) if qw else 0
            repeats = in_order / max(1, len(qw))
            broken, mid, inside, whole = self._broken(answer, aw, passage, body)
            q_set = frozenset(qw)
            first = aw[0] if aw else ""
            of_first = first in names and self.cues[spoken[at]].of([first])[0] <= 0 if clauses else False
            n_words = []
            for i, c in enumerate(clauses):
                w = aw if len(clauses) == 1 else words(c)
                n = len(w)
                n_words.append(n)
                gap, k, lang = gaps[at], known[at], spoken[at]
                at += 1
                if gap > 0:
                    # Names and numbers are in no language: words of the passage's or question's names, and clauses of nothing but capitalised words.
                    shown = split_words(c)
                    named = n <= 4 and all(a[0].isupper() or a.isdigit() for a in shown) and not (c.isupper() and n > 2)
                    if named or all(a in names or a.isdigit() for a in w):
                        gap = 0.0
                cues = self.cues[lang].of(w)
                tales, total = sum(self.tales[lang].of(w)), sum(cues)
                last = i == len(clauses) - 1
                echo = common(qw, w) / n if not q_set.isdisjoint(w) else 0.0
                end = self.ends.get(w[-1], -1.0 if w[-1] in names or w[-1].isdigit() else -3.0)
                quoted = '"' in c or "“" in c or "«" in c
                flat.append((
                    1.0, n <= 2, n >= 5, i == 0, last,
                    echo, echo * repeats, echo > 0.85 and repeats > 0.85, repeats > 0.9 and in_order >= 0.8 * len(aw),
                    max(-1.5, min(1.5, total / 10)), tales > 3, total / n / 4, total > 6 and tales < -3 and not quoted, total > 3, total > 3 and tales < 0 and not quoted,
                    quoted, w[0] in names and cues[0] <= 0, of_first, i == 0 and cues[0] > 0.5, i == 0 and cues[0] <= 0 and c[:1].isupper() and w[0] not in self.ends,
                    gap if k >= 8 else 0.0, gap > 0.3 and k >= 8, gap > 0.15 and k >= 20, q_n < 15,
                    last and broken, last and mid, last and answer.endswith(("...", "…", "-", "–")) and not whole, last and answer.endswith((",", ";", ":")),
                    last and end < -2.0 and n + i >= 3, whole, inside,
                ))
            sizes.append(n_words)
            repeated.append(repeats)
        x = np.array(flat, dtype=np.float64).reshape(-1, _FEATURES)
        ends = np.cumsum([len(n) for n in sizes])
        return [(n, x[e - len(n) : e], r) for n, e, r in zip(sizes, ends, repeated)]

    @staticmethod
    def _broken(answer: str, aw: list[str], passage: str, body: str) -> tuple[bool, bool, bool, bool]:
        """Whether the answer is the beginning of a sentence of the passage but not all of it; whether it stops inside a word; whether
        it is a part of the passage, its last word perhaps cut; whether it is one or more whole sentences."""
        text = " ".join(aw)
        if len(aw) < 2 or not text:
            return False, False, False, False
        inside = f" {text} " in body
        if not inside and f" {text}" not in body:
            return False, False, False, False
        sentences = [" ".join(words(s)) for s in _SENTENCE.split(passage)]
        begins = answer.lstrip("\"'“«¿¡(")[:1]
        for i, s in enumerate(sentences):
            if s == text:
                return False, False, True, True
        for i, s in enumerate(sentences):
            rest = text
            while rest and i < len(sentences) and s and rest.startswith(s + " "):
                rest, i = rest[len(s) + 1 :], i + 1
                s = sentences[i] if i < len(sentences) else ""
                if rest == s:
                    return False, False, True, True
            if rest and s.startswith(rest) and (begins.isupper() or not begins.isalpha()) and (len(aw) > 2 or s[len(rest) : len(rest) + 1] != " "):
                return True, s[len(rest) : len(rest) + 1] not in ("", " "), True, False
        return False, False, True, False


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, with a bit for each place of the first."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rest = full
    for w in b:
        if m := rest & where.get(w, 0):
            rest = ((rest + m) | (rest - m)) & full
    return len(a) - rest.bit_count()


def padded(sequences: list[np.ndarray], room: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, x, there): sequences of rows of features of about the same length, side by side in arrays of about `room` places at most."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        longest = max(1, int(sizes[order[i]] * 1.25))
        j = min(int(np.searchsorted(sizes[order], longest, "right")), i + max(1, room // longest))
        which = order[i:j]
        there = np.arange(sizes[which[-1]])[None, :] < sizes[which][:, None]
        x = np.zeros((*there.shape, _FEATURES))
        x[there] = np.concatenate([sequences[k] for k in which])
        yield which, x, there
        i = j


class ClauseField:
    """A linear-chain conditional random field, trained by gradient ascent on the log-likelihood."""

    def __init__(self, sequences: list[tuple[np.ndarray, list[int]]], steps: int = 120, rate: float = 0.2, ridge: float = 2e-4):
        n_tags = len(TAGS)
        self.emit, self.move = np.zeros((_FEATURES, n_tags)), np.zeros((n_tags, n_tags))
        if not sequences:
            return
        groups = [(x[there], there) for _, x, there in padded([f for f, _ in sequences])]
        gold_emit, gold_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        for x, y in sequences:
            np.add.at(gold_emit.T, y, x)
            np.add.at(gold_move, (y[:-1], y[1:]), 1)
        m = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        v = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            one, two = -gold_emit, -gold_move
            for x, there in groups:
                p, moves = self._expected(x, there)
                one, two = one + np.einsum("cf,ck->fk", x, p), two + moves
            grads = [-one / len(sequences) - ridge * self.emit, -two / len(sequences) - ridge * self.move]
            for p, g, a, b in zip((self.emit, self.move), grads, m, v):  # Adam
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)

    def _expected(self, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the tags of each clause, and expected numbers of moves, by forward and backward sums."""
        score = np.zeros((*there.shape, len(TAGS)))
        score[there] = np.einsum("cf,fk->ck", x, self.emit)  # not by BLAS, whose threads cost more than they gain here
        n, longest, k = score.shape
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            s = ahead[:, t - 1, :, None] + self.move
            top = s.max(1)
            ahead[:, t] = np.where(there[:, t, None], top + np.log(np.exp(s - top[:, None]).sum(1)) + score[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            s = self.move + (score[:, t + 1] + back[:, t + 1])[:, None, :]
            top = s.max(2)
            back[:, t] = np.where(there[:, t + 1, None], top + np.log(np.exp(s - top[:, :, None]).sum(2)), 0.0)
        last = ahead[:, -1]
        top = last.max(1)
        total = top + np.log(np.exp(last - top[:, None]).sum(1))
        one = np.exp(ahead + back - total[:, None, None])[there]
        two = np.zeros((k, k))
        for t in range(longest - 1):
            p = np.exp(ahead[:, t, :, None] + self.move + (score[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, None, None])
            two += (p * there[:, t + 1, None, None]).sum(0)
        return one, two

    def tag(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely tags of each sequence (Viterbi)."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        for which, x, there in padded(sequences):
            score = x @ self.emit
            best, back = score[:, 0], []
            for t in range(1, there.shape[1]):
                s = best[:, :, None] + self.move
                back.append(np.where(there[:, t, None], s.argmax(1), np.arange(len(TAGS))))
                best = np.where(there[:, t, None], s.max(1) + score[:, t], best)
            path = np.zeros(there.shape, int)
            path[:, -1] = best.argmax(1)
            for t in range(there.shape[1] - 2, -1, -1):
                path[:, t] = back[t][np.arange(len(path)), path[:, t + 1]]
            for i, p, n in zip(which, path, there.sum(1)):
                out[i] = p[:n]
        return out


class DefectModel:
    def __init__(self, setting: Setting, rows: list[tuple[str, str]], seed: int = 7, refusals: dict = REFUSALS):
        """rows: (question, passage) of the sample."""
        self.setting = setting
        made, passages = examples(setting, rows, seed, refusals)
        sequences = []
        for part in range(PARTS):
            # Phrases of one part, with the words learned from the others.
            setting.learn(passages, refusals, STORY, part)
            mine = [e for e in made if e[5] == part]
            for (_, x, _), (*_, tag, last, _) in zip(setting.features([e[:3] for e in mine], Memo()), mine):
                if len(x):
                    sequences.append((x, [tag] * (len(x) - 1) + [last]))
        setting.learn(passages, refusals, STORY)
        self.field = ClauseField(sequences)

    def defect(self, question: str, answer: str | None, passage: str | None) -> str | None:
        return self.defects([(question, answer, passage)], Memo())[0]

    def defects(self, rows: list[tuple[str, str | None, str | None]], memo: Memo) -> list[str | None]:
        out: list[str | None] = ["empty" if is_empty(a) else None for _, a, _ in rows]
        judged = [i for i, d in enumerate(out) if d is None]
        found = self.setting.features([rows[i] for i in judged], memo)
        for i, (sizes, _, repeats), tags in zip(judged, found, self.field.tag([x for _, x, _ in found])):
            share = np.bincount(tags, weights=sizes, minlength=len(TAGS)) / max(1, sum(sizes))
            if share[ECHO] >= 0.8 and repeats >= 0.85:
                out[i] = "copy"
            elif share[REFUSAL] >= 0.5:
                out[i] = "refusal"
            elif share[FOREIGN] >= 0.5:
                out[i] = "language"
            elif len(tags) and tags[-1] == UNFINISHED:
                out[i] = "truncated"
        return out


def deal(phrases: tuple[str, ...]) -> list[str]:
    """The phrases, a multiple of PARTS places long."""
    return [*phrases, *[""] * (-len(phrases) % PARTS)]


def examples(setting: Setting, rows: list[tuple[str, str]], seed: int, refusals: dict = REFUSALS) -> tuple[list[tuple[str, str, str, int, int, int]], dict[str, list[str]]]:
    """[(question, response, passage, tag of its clauses, tag of the last, part)]: made responses of every kind for the questions and passages of
    the sample; the phrases are dealt into parts, all else by turns. And the passages by language."""
    rng = random.Random(seed)
    rows = [(clean(q), clean(p)) for q, p in rows]
    own, _ = setting.own_languages([q for q, _ in rows], [p for _, p in rows]) if rows else ([], None)
    parsed = []
    for (q, p), lang in zip(rows, own):
        s = [x.strip() for x in _SENTENCE.split(p) if len(words(x)) >= 4]
        if s and len(words(q)) >= 3:
            parsed.append((q, p, s, LANGS[lang]))
    parsed.sort(key=lambda r: zlib.crc32((r[0] + r[1]).encode()))
    by_lang: dict[str, list[str]] = {}
    for _, _, s, code in parsed:
        by_lang.setdefault(code, []).extend(s[:3])
    out = []

    def add(q: str, a: str, p: str, tag: int, last: int | None = None, part: int | None = None) -> None:
        if not is_empty(a):
            out.append((q, a, p, tag, tag if last is None else last, len(out) % PARTS if part is None else part))

    # Few rows are gone through several times, each time with other draws.
    for q, p, s, code in parsed * max(1, 200 // max(1, len(parsed))):
        names = sorted({w for w in _WORD.findall(p)[1:] if w[:1].isupper() and len(w) > 2}) or ["Anna"]
        sentence = rng.choice(s)
        w = _WORD.findall(sentence)
        start = rng.randrange(max(1, len(w) - 3))
        span = " ".join(w[start + (start == 0) : start + (start == 0) + rng.randint(1, 4)])
        full = sentence if rng.random() < 0.6 else sentence.rstrip(".")
        add(q, full, p, ANSWER)
        add(q, span, p, ANSWER)
        other = rng.choice(by_lang[code])
        add(q, rng.choice((rng.choice(names), str(rng.randint(2, 2000)), other, other.split(", ", 1)[-1].rstrip("."))), p, ANSWER)
        for _ in range(2):
            story = rng.randrange(len(STORY[code]))
            add(q, STORY[code][story].format(n=rng.choice(names)), p, ANSWER, part=story % PARTS)
        qw = q.split()
        add(q, " ".join(qw[rng.randint(1, min(3, len(qw) - 2)) :]).rstrip("?!. ") + rng.choice((" in 1987", " because of the rain.", " and that was good.", " in 1905.")), p, ANSWER) if code == "en" and len(qw) > 4 else None
        # Broken off: inside a word, between words, at a comma, with or without dots.
        cut = rng.randint(max(3, len(sentence) // 3), max(4, len(sentence) - 3))
        part = sentence[:cut].rstrip()
        if rng.random() < 0.5 and " " in part:
            part = part.rsplit(" ", 1)[0]
        if len(words(part)) >= 3 and len(words(part)) <= len(w):
            add(q, part + rng.choice(("", "", "", "...", "-", "…")), p, ANSWER, UNFINISHED)
        # The question again.
        again = rng.choice((q, q.rstrip("?"), q.upper(), q.lower(), f"Q: {q}", f"Answer: {q.rstrip('?')} ...", q.rstrip("?") + ".", f"{q} {q}", f"Question: {q}"))
        add(q, again, p, ECHO)
        # Another language.
        codes = [c for c in by_lang if c != code]
        if codes:
            alien = rng.choice(by_lang[rng.choice(codes)])
            pieces = alien.split(", ")
            add(q, rng.choice((alien, alien.rstrip("."), pieces[-1].rstrip("."))), p, FOREIGN)
        for _ in range(2):
            opening, core, closing = refusals[code if rng.random() < 0.6 else "en"]
            number = rng.randrange(len(core))
            text, dealt = core[number], number % PARTS
            # Openings and closings are dealt as well, where there are several.
            if rng.random() < 0.7:
                text = f"{rng.choice(opening[dealt::PARTS] or opening)} {text}"
            text = text[:1].upper() + text[1:]
            if rng.random() < 0.5:
                end = rng.choice(closing[dealt::PARTS] or closing)
                text += (". " if end[:1].isupper() or not end[:1].isalpha() else ", ") + end
            elif rng.random() < 0.8:
                text += "."
            add(q, text if rng.random() < 0.9 else text.lower(), p, REFUSAL, part=dealt)
    texts: dict[str, list[str]] = {}
    for p, code in dict.fromkeys((p, code) for _, p, _, code in parsed):
        texts.setdefault(code, []).append(p)
    return out, texts


def word_totals(passages: DataFrame) -> DataFrame:
    """(word, n, final): how often the words that make up a FREQUENT-th of all words, and two or more, occur in the different passages, and
    how often they end a clause."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, final = Counter(), Counter()
        for b in batches:
            for text in b["passage"]:
                text = clean(text).lower()
                every.update(split_words(text))
                final.update(last_words(text))
            if len(every) > 300_000:
                yield pd.DataFrame({"word": list(every), "n": list(every.values()), "final": [final[w] for w in every]})
                every, final = Counter(), Counter()
        yield pd.DataFrame({"word": list(every), "n": list(every.values()), "final": [final[w] for w in every]}).astype({"word": str, "n": "int64", "final": "int64"})

    texts = passages.where("passage IS NOT NULL").select("passage").distinct()
    each = texts.mapInPandas(count, "word STRING, n BIGINT, final BIGINT").groupBy("word").agg(F.sum("n").alias("n"), F.sum("final").alias("final"))
    each = materialise(each, "words")
    total = each.agg(F.sum("n")).first()[0] or 0
    return each.where(F.col("n") >= max(2, -(-total // FREQUENT)))


def train(df: DataFrame, per_language: int = 300) -> DefectModel:
    """Fit the language filters and the field on bounded samples of the table; how words end clauses is counted on all passages."""
    filters = fit_filter(df, "passage", "lang", per_language)
    usable = df.where("question IS NOT NULL").where(F.length("passage") <= LONGEST).select("question", "passage", F.xxhash64("question", "passage").alias("draw"))
    n = usable.count()
    # A hash below the bound is expected of four times the sample, or of all; repeated rows have one hash, and the lowest are taken.
    share = min(1.0, 4 * SAMPLE / max(n, 1))
    rows = usable.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).distinct().orderBy("draw", "question", "passage").limit(SAMPLE).collect()
    return DefectModel(Setting(filters, [tuple(r) for r in word_totals(df).collect()]), [(r[0], r[1]) for r in rows])


def response_defects(df: DataFrame, model: DefectModel, id_col: str = "qg_id") -> DataFrame:
    """(id, defect) of each row with a question; defect is null for a sound pair."""
    kind = dict(df.dtypes)[id_col]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo()
        for b in batches:
            rows, out = list(zip(b["__q"], b["__a"], b["__p"])), []
            for part in chunks([q + (a or "") for q, a, _ in rows]):
                out += model.defects(rows[part], memo)
            yield pd.DataFrame({id_col: b[id_col], "defect": pd.Series(out, index=b.index, dtype=object)})

    asked = F.col("question").isNotNull() & F.col("question").rlike(r"[\p{L}\p{N}]")
    rows = df.where(asked).select(F.col(id_col), F.col("question").alias("__q"), F.col("answer").alias("__a"), F.col("passage").alias("__p"))
    return rows.mapInPandas(judge, f"`{id_col}` {kind}, defect STRING")
