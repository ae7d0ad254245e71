"""Triples from parsed sentences.

The parse comes from a provider as a column: for each sentence its words with their heads, its named entities, and the
mentions of its coreference chains. A document's sentences are one row, so the work is a `mapInPandas` over documents
without any shuffle; within a sentence, everything is looked up in an index of children by head.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

WORDS = "ARRAY<STRUCT<id: INT, text: STRING, lemma: STRING, upos: STRING, feats: STRING, head: INT, deprel: STRING>>"
PARSE = f"doc_id BIGINT, sentences ARRAY<STRUCT<text: STRING, words: {WORDS}, ents: ARRAY<STRUCT<words: ARRAY<INT>, type: STRING, text: STRING>>>>, chains ARRAY<STRUCT<representative: STRING, mentions: ARRAY<STRING>>>"
TRIPLE = (
    "doc_id BIGINT, ord INT, subject STRING, subject_type STRING, relation STRING, object STRING, object_type STRING, source STRING, verb_text STRING, is_passive BOOLEAN, object_surface STRING, object_case STRING, "
    "sentence_idx INT, coref_distance INT, source_depth INT, answer_depth INT"
)
# The dependency relations that make subjects, objects, clauses and appositions, and the types they ask for.
SUBJECTS = ("nsubj", "nsubj:pass", "nsubj:cop")
OBJECTS = ("obj", "iobj", "obl", "obl:agent")
CLAUSES = ("relcl", "advcl", "acl", "csubj", "ccomp", "xcomp")
APPOSITIONS = ("appos", "nmod:unmarked", "nmod:tmod")
DATE_TYPES = ("DATE", "CARDINAL", "ORDINAL")
PLACE_TYPES = ("GPE", "LOC", "FAC")
PRONOUNS = ("he", "she", "they", "it", "his", "her", "their", "him", "them", "we", "i", "me", "us")


@dataclass
class Sentence:
    text: str
    words: dict[int, dict]
    children: dict[int, list[dict]] = field(default_factory=lambda: defaultdict(list))
    named: dict[int, tuple[str, str, str]] = field(default_factory=dict)  # word: name, type, surface

    @classmethod
    def of(cls, row: dict) -> Sentence:
        s = cls(row["text"], {w["id"]: w for w in row["words"]})
        for w in row["words"]:
            s.children[w["head"]].append(w)
        for e in row["ents"] if row["ents"] is not None else []:
            parts = [s.words[i] for i in sorted(e["words"]) if i in s.words and s.words[i]["text"] != "'s"]
            name = " ".join((w["lemma"] if "Case=" in (w["feats"] or "") else w["text"]).replace("#", "") for w in parts)
            s.named.update({i: (name, e["type"], e["text"]) for i in e["words"]})
        return s

    def below(self, word: dict, *deprels: str) -> list[dict]:
        return [w for w in self.children[word["id"]] if w["deprel"] in deprels]

    def joined(self, word: dict) -> list[dict]:
        """The word and what is coordinated with it, depth first; a cycle ends."""
        out, stack, seen = [], [word], set()
        while stack:
            w = stack.pop()
            if w["id"] not in seen:
                seen.add(w["id"])
                out.append(w)
                stack += reversed(self.below(w, "conj"))
        return out

    def mention(self, word: dict) -> tuple[str, str | None]:
        name = self.named.get(word["id"])
        return name[:2] if name else (word["lemma"].replace("#", ""), None)

    def feature(self, word: dict, name: str) -> str:
        pairs = (p.split("=", 1) for p in (word["feats"] or "").split("|") if "=" in p)
        return dict(pairs).get(name, "")

    def preposition(self, word: dict) -> str | None:
        return next((w["lemma"] for w in self.below(word, "case", "mark")), None)

    def depth(self, word: dict) -> int:
        n, seen = 0, set()
        while word["head"] != 0 and word["id"] not in seen and word["head"] in self.words:
            seen.add(word["id"])
            word = self.words[word["head"]]
            n += 1
        return n

    def phrase(self, word: dict) -> str | None:
        """A common noun with its compounds and adjectives, those coordinated with them and the conjunctions between."""
        if word["id"] in self.named:
            return None
        parts: dict[int, dict] = {}
        for m in self.below(word, "compound", "amod"):
            if m["upos"] in ("NOUN", "VERB", "ADJ"):
                for w in self.joined(m):
                    parts[w["id"]] = w
                    parts.update({c["id"]: c for c in self.below(w, "cc")})
        return " ".join([parts[i]["text"] for i in sorted(parts)] + [word["lemma"].replace("#", "")]) if parts else None

    def doers(self, verb: dict) -> tuple[list[dict], bool]:
        """The subjects of a verb; those of the verb it is coordinated with; else its objects (then True)."""
        lookup = [verb]
        if verb["deprel"] == "conj" and self.words.get(verb["head"], {}).get("upos") in ("VERB", "AUX"):
            lookup.append(self.words[verb["head"]])
        for v in lookup:
            if found := [x for w in self.below(v, *SUBJECTS) for x in self.joined(w)]:
                return found, False
        return [x for w in self.below(verb, "obj") for x in self.joined(w)], True

    def triples(self) -> Iterator[dict]:
        for verb in self.words.values():
            if verb["upos"] == "VERB":
                yield from self._of_verb(verb)
        yield from self._of_copula()
        yield from self._of_apposition()

    def _of_verb(self, verb: dict) -> Iterator[dict]:
        subjects, promoted = self.doers(verb)
        passive = "Voice=Pass" in (verb["feats"] or "") or bool(self.below(verb, "nsubj:pass"))
        used = {w["id"] for w in subjects} if promoted else set()
        objects: dict[int, tuple[dict, str]] = {}
        for w in self.below(verb, *OBJECTS):
            if w["id"] not in used:
                for x in self.joined(w):
                    objects.setdefault(x["id"], (x, w["deprel"]))
        for s in subjects:
            for word, deprel in objects.values():
                owner = None if word["id"] in self.named else next((w for w in self.below(word, "nmod:poss", "nmod") if w["id"] in self.named), None)
                end = owner or word
                name, kind = self.mention(end)
                prep = None if deprel in ("obj", "iobj") else self.preposition(word) or ("by" if deprel == "obl:agent" else None)
                yield self._row(self.mention(s), verb["lemma"] + (f"_{prep}" if prep else ""), (self.phrase(end) or name, kind), end, verb_text=verb["text"], is_passive=passive, object_surface=self.named.get(end["id"], ("", "", ""))[2])

    def _of_copula(self) -> Iterator[dict]:
        for head in dict.fromkeys(w["head"] for w in self.words.values() if w["deprel"] == "cop"):
            word = self.words.get(head)
            subject = next(iter(self.below(word, *SUBJECTS)), None) if word else None
            if subject is None:
                continue
            yield self._row(self.mention(subject), "be", self.mention(word), word)
            for n in self.below(word, "nmod", "nmod:poss"):
                yield self._row(self.mention(subject), f"be_{self.preposition(n) or 'of'}", self.mention(n), n)

    def _of_apposition(self) -> Iterator[dict]:
        for w in self.words.values():
            head = self.words.get(w["head"])
            if w["deprel"] not in APPOSITIONS or head is None:
                continue
            (name, kind), (other, other_kind) = self.mention(head), self.mention(w)
            named = w["id"] in self.named
            date = other_kind in DATE_TYPES or (not named and w["lemma"].isdigit() and len(w["lemma"]) == 4)
            if name == other or not (date or named) or (w["deprel"] == "nmod:unmarked" and not date):
                continue
            places = kind in PLACE_TYPES and other_kind in PLACE_TYPES
            row = self._row((name, kind), "year" if date else "located_in" if places else "also_known_as", (other, other_kind), w)
            yield row | {"object_case": "", "answer_depth": 0}

    def _row(self, subject: tuple, relation: str, obj: tuple, end: dict, **more) -> dict:
        out = {"subject": subject[0], "subject_type": subject[1], "relation": relation, "object": obj[0], "object_type": obj[1], "source": self.text, "verb_text": "", "is_passive": False, "object_surface": ""}
        return out | {"object_case": self.feature(end, "Case"), "answer_depth": self.depth(end), "coref_distance": 0} | more


def document_triples(sentences: list[dict]) -> list[dict]:
    out = []
    for i, row in enumerate(sentences):
        s = Sentence.of(row)
        clauses = sum(w["deprel"] in CLAUSES for w in s.words.values())
        out += [t | {"sentence_idx": i, "source_depth": clauses} for t in s.triples()]
    return out


def by_chain(triples: list[dict], chains: list[dict] | None) -> list[dict]:
    """Pronouns replaced by their chain's representative (the last chain of a pronoun counts)."""
    names = {m.lower(): c["representative"] for c in (chains if chains is not None else []) for m in c["mentions"] if m.lower() in PRONOUNS}
    out = []
    for t in triples:
        s, o = names.get(t["subject"].lower(), t["subject"]), names.get(t["object"].lower(), t["object"])
        changed = (s, o) != (t["subject"], t["object"])
        out.append(t | {"subject": s, "object": o} | ({"coref_distance": 1} if changed else {}))
    return out


def extract(parsed: DataFrame, resolve: bool = False) -> DataFrame:
    """The triples of each parsed document, with pronouns resolved by its chains if asked for."""
    columns = [c.split()[0] for c in TRIPLE.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, sentences, chains in zip(batch["doc_id"], batch["sentences"], batch["chains"]):
                found = document_triples(sentences if sentences is not None else [])
                found = by_chain(found, chains) if resolve else found
                rows += [t | {"doc_id": doc, "ord": i} for i, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=columns)

    return parsed.select("doc_id", "sentences", "chains").mapInPandas(work, TRIPLE)
