"""Licence scans with a generalised suffix automaton of licence tokens.

All templates and phrases go into one suffix automaton over word ids. A text streams through it: after
each word the automaton knows the longest suffix of the words read that stands in some template (the
matching statistics). Matches that can't be extended to the right and are long enough become pairs of
spans (text, template); per template they are chained, both spans going forward, the text's gap
bounded, and the chain that covers most words of the template gives its coverage. A template covered well
enough gives its label. Phrases are found in the same pass: one ends where the state, or a state on its
suffix links, is that phrase.

Only runs of words whose neighbouring pairs all stand in a template (told by a table of their hashes, which lets a
few others pass) reach the automaton: no match of two words or more lies outside them, so nothing is lost.
Each task works on whole texts; nothing is shuffled.

Templates are whole short licences, the notices that files of longer ones carry (licence_texts.py), and typical
passages; ``read_templates`` adds a folder of licence texts, one file each, of any length.

Cases: null and empty texts have no words, no labels and score 0; repeated rows are judged one by one; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, slices, table, texts
from .licence_texts import LICENCES, PASSAGES

def ascii_words(text: str) -> list[str]:
    return text.encode().translate(ALNUM_TABLE).decode().split()


#: Phrases whose every place counts, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, words): whole licences and notices first, then passages.
TEMPLATES = (*((label, " ".join(ascii_words(text))) for label, text in LICENCES), *PASSAGES)
MIN_MATCH = 3
MIN_COVER = 0.8
MAX_GAP = 8
PAIR_TABLE = 1 << 20


class SuffixAutomaton:
    """Generalised suffix automaton; a state knows its length, suffix link, and ends in the sequences."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self._extend(state, word)
                self.ends[state].add((which, at + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, above: int, word: int, below: int) -> int:
        """The state for the longest string of ``above`` plus ``word``, parted from ``below`` if need be."""
        if self.length[below] == self.length[above] + 1:
            return below
        clone = self._state(self.length[above] + 1, self.link[below], dict(self.next[below]))
        self.link[below] = clone
        while above >= 0 and self.next[above].get(word) == below:
            self.next[above][word] = clone
            above = self.link[above]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def stream(self, words: Sequence[int]):
        """(state, length of the longest suffix that stands in a sequence) after each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


def chain_cover(matches: list[tuple[int, int, int]], max_gap: int) -> tuple[int, int, int]:
    """Most template words that one chain of (text start, template start, words) covers, and its text span."""
    best: list[tuple[int, int]] = []  # covered, start of the chain in the text
    top = (0, 0, 0)
    matches = sorted(matches)
    longest, low = max((m[2] for m in matches), default=0), 0
    for i, (start, where, n) in enumerate(matches):
        best.append((n, start))
        while matches[low][0] + longest + max_gap < start:
            low += 1
        for j in range(low, i):
            s, w, m = matches[j]
            if s + m + max_gap < start or w >= where or s >= start:
                continue
            gain = min(n, start + n - (s + m), where + n - (w + m))  # words that the earlier match lacks
            if gain > 0 and best[j][0] + gain > best[i][0]:
                best[i] = (best[j][0] + gain, best[j][1])
        if best[i][0] > top[0]:
            top = (best[i][0], best[i][1], start + n)
    return top


def _pair(ids: np.ndarray) -> np.ndarray:
    """Places in the tables of pairs of each word with the next."""
    return (ids[:-1] * 0x9E3779B1 + ids[1:] * 0x85EBCA77 >> 7) & (PAIR_TABLE - 1)


class LicenseScanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.vocabulary: dict[bytes, int] = {}
        sequences = [
            [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.encode().split()]
            for text in (*(p for p, _ in phrases), *(t for _, t in templates))
        ]
        self.first_template = len(phrases)
        self.sequences = sequences
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.automaton = SuffixAutomaton(sequences)
        self.pairs, self.phrase_pairs = np.zeros(PAIR_TABLE, bool), np.zeros(PAIR_TABLE, bool)
        for k, s in enumerate(sequences):
            own = _pair(np.array(s, np.int64))
            self.pairs[own] = True
            if k < self.first_template:
                self.phrase_pairs[own] = True
        self.phrases_at = self._phrases()

    def _phrases(self) -> list[list[tuple[int, int]]]:
        """By state, (phrase, its words) of the phrases that end every long enough string of the state: its own and those of its link."""
        sizes = [(k, len(self.sequences[k])) for k in range(self.first_template)]
        length, link, found = self.automaton.length, self.automaton.link, [[] for _ in self.automaton.length]
        for state in sorted(range(1, len(length)), key=length.__getitem__):  # a link's strings are shorter
            above, ends = link[state], self.automaton.ends[state]
            found[state] = [(k, n) for k, n in sizes if length[above] < n <= length[state] and (k, n) in ends] + found[above]
        return found

    def scan(self, text: bytes) -> dict:
        words = text.translate(ALNUM_TABLE).split()
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        places: list[tuple[int, int]] = []  # phrase, start
        matches: dict[int, list[tuple[int, int, int]]] = {}
        if len(ids) > 1:
            place = _pair(ids)
            near = self.pairs[place] & (ids[:-1] > 0) & (ids[1:] > 0)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
            base = np.concatenate([[0], np.cumsum(self.phrase_pairs[place])])
            for low, high in zip(edges[::2], edges[1::2]):  # pairs low..high-1: words low..high
                if high + 1 - low >= self.min_match or base[high] > base[low]:
                    self._run(ids[low : high + 1].tolist(), int(low), places, matches)
        cover = {k: chain_cover(found, self.max_gap) for k, found in matches.items()}
        found = {k: (n / len(self.sequences[k]), a, b) for k, (n, a, b) in cover.items()}
        base_labels = sorted({self.labels[k] for k, _ in places})
        spans = [
            {"label": self.labels[k], "first": a, "past": b, "cover": c} for k, (c, a, b) in found.items() if c >= self.min_cover
        ]
        score = max([0.0, *(min(1.0, c) for c, _, _ in found.values()), *(1.0 for _ in base_labels)])
        return {
            "n_words": len(words),
            "places": sorted((start, self.labels[k]) for k, start in places),
            "base_labels": base_labels,
            "labels": sorted({*base_labels, *(s["label"] for s in spans)}),
            "spans": sorted(spans, key=lambda s: (s["first"], s["past"], s["label"])),
            "score": score,
        }

    def _run(self, ids: list[int], offset: int, places: list, matches: dict) -> None:
        before = (0, 0)
        automaton = self.automaton
        for i, (state, length) in enumerate(automaton.stream(ids)):
            if before[1] >= self.min_match and length <= before[1]:
                self._match(before, offset + i, matches)
            before = (state, length)
            for phrase, n in self.phrases_at[state]:
                if n <= length:
                    places.append((phrase, offset + i + 1 - n))
        if before[1] >= self.min_match:
            self._match(before, offset + len(ids), matches)

    def _match(self, before: tuple[int, int], past: int, matches: dict) -> None:
        state, length = before
        for which, end in self.automaton.ends[state]:
            if which >= self.first_template and end >= length:
                matches.setdefault(which, []).append((past - length, end - length, length))


SCHEMA = (
    "doc_id long, n_words long, places array<struct<first: int, label: string>>, base_labels array<string>, labels array<string>, "
    "spans array<struct<label: string, first: int, past: int, cover: double>>, score double"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("first", pa.int32()), ("label", pa.string())]))),
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("past", pa.int32()), ("cover", pa.float64())]))),
        ("score", pa.float64()),
    ]
)


def read_templates(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(label, words) of the licence texts in a folder: a file's name without its ending is its label.

    The texts become part of the model that every task holds: some hundred of them are a few megabytes.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    known = {(r["name"].rsplit(".txt", 1)[0].lower(), " ".join(bytes(r["content"]).translate(ALNUM_TABLE).decode("utf-8", "replace").split())) for r in files.toLocalIterator()}
    return tuple(sorted(x for x in known if x[1]))


def scan_licenses(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """Per document: words, places of phrases, labels, and covered template spans (in words)."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or LicenseScanner())

    def scan(batches):
        scanner = shared.value
        for part in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                row = scanner.scan(text)
                row["places"] = [{"first": first, "label": label} for first, label in row["places"]]
                rows.append({"doc_id": doc_id} | row)
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )
