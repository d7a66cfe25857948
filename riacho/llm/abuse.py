"""Abusive, hateful or sexual passages, scored by their nearest labelled examples.

Every stretch of up to ``WINDOW`` words between words that positive examples have is a passage of its document. Examples are passages of hand-reviewed documents: of
each positive one those that its words single out against the whole corpus, of each negative one those nearest to them.
Passages meet examples by exact TF-IDF cosine through a block-max inverted index: a passage whose upper bound against all
positive examples is below ``RADIUS`` has no positive neighbour and scores 0, any other is searched. Equal examples are one
neighbour with the share of positive documents among theirs. Distance-weighted votes of the neighbours are the raw score,
which reviewed documents, judged without their own passages, calibrate. Marks given by mistake show in the documents that
their examples bring in: reviewers marked them as they mark ordinary ones, so these examples are refused.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riacho.scale import checked_broadcast, materialize

#: Reviewed documents that the examples may come from; the fit is bounded, everything else covers all documents.
LABELLED_DOCS = 6_000
#: Words of a passage at most and at least.
WINDOW, LEAST_WORDS = 10, 3
NEIGHBOURS = 9
#: Least cosine of a neighbour that votes.
RADIUS = 0.35
#: Added to a distance before its inverse is a vote's weight.
NEAR = 0.1
#: Weight of one and a half unmarked examples at the radius, so that one far neighbour alone decides nothing.
DOUBT = 1.5 / (1 - RADIUS + NEAR)
#: Reviewed documents that the raw score itself stands for in each step of the calibration.
PRIOR = 2.0
#: Further passages of a positive document are examples from this share of its best passage's evidence.
FURTHER = 0.7
#: An example is refused if its documents are so many times likelier ordinary than toxic, by raw score and reviewers' marks.
REFUSED = 20.0
BLOCK = 64
#: Owner of examples that several documents have: no document's number, nor -1, which asks for all.
SHARED = np.iinfo(np.int64).min
#: Documents near examples whose numbers may be broadcast; if there are more, all documents are judged again.
NEAR_ROWS = 1_000_000
#: Bytes of text, and passages, handled at once.
CHUNK, PASSAGES = 6_000_000, 50_000

_MARKS = re.compile("[̀-ͯ]+")
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-*_]){2,}[^\W\d_](?![^\W_])")
_GLUE = re.compile(r"[ .\-*_]")
_TOKEN = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*[@$*]?|[@$*][^\W_]+(?:[@$*!][^\W_]+)*")
_LEET = str.maketrans({"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_AGAIN = re.compile(r"(.)\1+")


def _canonical(token: str) -> str:
    """Spelling without look-alike signs and repeated letters; empty for numbers. A masked letter stays ``*``."""
    if token.isalpha():
        return _AGAIN.sub(r"\1", token)
    if not any(c.isalpha() for c in token):
        return ""
    if token[0] == "$":  # a ticker
        return ""
    letters = sum(c.isalpha() for c in token)
    digits = sum(c.isdigit() for c in token)
    if digits >= letters:
        return ""
    return _folded(token)


def _folded(token: str) -> str:
    return _AGAIN.sub(r"\1", token.translate(_LEET))


class Spelling(dict):
    """Token -> canonical word, remembered; masked words become the only telling word they fit.

    Tokens with at least as many digits as letters are numbers unless they fold to a telling word; those without any letter
    always are, since amounts fold to words too (150: iso).
    """

    def __init__(self, telling: frozenset[str] | set[str] = frozenset()) -> None:
        super().__init__()
        self.telling = frozenset(telling)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(telling):
            self.by_length[len(w)].append(w)

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        word = _canonical(token)
        if not word and token[0] != "$" and any(c.isalpha() for c in token):
            folded = _folded(token)
            word = folded if folded in self.telling else ""
        if "*" in word and word.strip("*"):
            mask = re.compile("".join("." if c == "*" else re.escape(c) for c in word) + r"\Z")
            fits = [w for w in self.by_length[len(word)] if mask.match(w)]
            word = fits[0] if len(fits) == 1 else word.replace("*", "")
        self[token] = word
        return word


def words(text: str, spelling: Spelling) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFD", low))
    low = _SPELT.sub(lambda m: _GLUE.sub("", m.group()), low)
    return [w for w in map(spelling.__getitem__, _TOKEN.findall(low)) if w]


class BlockMaxIndex:
    """Inverted index over unit vectors with the largest weight of each term in each block of examples.

    Queries are searched together, block by block: a block is opened only for those whose upper bound on it reaches both
    ``least`` and their k-th best so far, so every answer is exact.
    """

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, owners: np.ndarray | None = None) -> None:
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.owners = np.full(self.n, -1, np.int64) if owners is None else owners
        self.bounds = np.zeros((n_terms, self.blocks), np.float32)
        self.opened: list[tuple[np.ndarray, np.ndarray]] = []  # term -> row, and the weights of each row in the block
        for b in range(self.blocks):
            part = vectors[b * BLOCK : (b + 1) * BLOCK]
            terms = sorted({t for v in part for t in v})
            row = np.zeros(n_terms, np.int32)
            row[terms] = np.arange(1, len(terms) + 1)
            table = np.zeros((len(terms) + 1, len(part)), np.float32)
            for i, v in enumerate(part):
                table[row[list(v)], i] = list(v.values())
            self.opened.append((row, table))
            self.bounds[terms, b] = table[1:].max(1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = 0.0, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), each queries x k, of the nearest examples with a cosine above 0 and of ``least``.

        ``terms`` and ``weights`` are queries x words; the weights of a repeated word add up. Examples owned by the
        query's document in ``docs`` are left out. Ties go to the smaller number; missing neighbours are -1.
        """
        n = len(terms)
        ids, best = np.full((n, k), -1, np.int64), np.zeros((n, k), np.float32)
        upper = np.zeros((n, self.blocks), np.float32)
        for j in range(terms.shape[1]):
            upper += self.bounds[terms[:, j]] * weights[:, j, None].astype(np.float32)
        for b in range(self.blocks):
            at = np.flatnonzero((upper[:, b] > 0) & (upper[:, b] >= np.maximum(best[:, -1], least) - 1e-5))
            if not len(at):
                continue
            row, table = self.opened[b]
            cos = np.zeros((len(at), table.shape[1]), np.float32)
            for j in range(terms.shape[1]):
                cos += table[row[terms[at, j]]] * weights[at, j, None].astype(np.float32)
            if docs is not None:
                cos[self.owners[b * BLOCK : b * BLOCK + table.shape[1]] == docs[at, None]] = 0
            cos[(cos <= 0) | (cos < least)] = 0
            some = cos.any(1)
            at, cos = at[some], cos[some]
            both = np.concatenate([best[at], cos], 1)
            names = np.concatenate([ids[at], np.broadcast_to(np.arange(table.shape[1]) + b * BLOCK, cos.shape)], 1)
            order = np.argsort(-both, 1, kind="stable")[:, :k]
            best[at] = np.take_along_axis(both, order, 1)
            ids[at] = np.where(best[at] > 0, np.take_along_axis(names, order, 1), -1)
        return ids, best


class Numbers:
    """Raw token (no blank inside) -> numbers of its words, remembered; 0 stands for words beyond the vocabulary."""

    def __init__(self, number: dict[str, int], spelling: Spelling, grow: bool = False) -> None:
        self.number, self.spelling, self.grow = number, spelling, grow
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> int:
        return self.number.setdefault(word, len(self.number) + 1) if self.grow else self.number.get(word, 0)

    def __call__(self, token: str) -> tuple[int, ...]:
        out = self.known.get(token)
        if out is None:
            if len(self.known) > 500_000:
                self.known.clear()
            out = self.known[token] = tuple(map(self.of_word, words(token, self.spelling)))
        return out


def numbered(texts: pa.Array, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of all texts, first position of each text and the end).

    Tokens are split and told apart by Arrow; Python sees each distinct one once. Three or more single letters in a row
    are one spelt word.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    found = [numbers(t) for t in distinct]
    count = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for f in found for i in f), np.int64, int(count.sum()))
    offset = np.concatenate([[0], np.cumsum(count)])
    single = np.fromiter((t[0].isalpha() and (len(t) == 1 or len(t) <= 3 and not any(c.isalnum() for c in t[1:])) for t in map(lambda t: t or " ", distinct)), bool, len(distinct))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n, at = count[codes], offset[codes]
    extra = []
    if single.any():
        lone = np.concatenate([[False], single[codes], [False]])
        edge = np.flatnonzero(lone[1:] != lone[:-1])
        inner = bounds[1:-1]
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s < 3:
                continue
            cuts = inner[np.searchsorted(inner, s, "right") : np.searchsorted(inner, e, "left")].tolist()  # no word passes a text
            for a, b in zip([s, *cuts], [*cuts, e], strict=True):
                if b - a >= 3:
                    n[a:b] = 0
                    word = numbers("".join(distinct[codes[i]][0] for i in range(a, b)))
                    n[a] = len(word)
                    at[a] = len(flat) + len(extra)
                    extra += word
    if extra:
        flat = np.concatenate([flat, extra])
    before = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(at - before[:-1], n) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.int64)
    return out.astype(np.int64), before[bounds]


def windows(ids: np.ndarray, starts: np.ndarray, told: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, end) of the passages: from each told word to the last told one within ``width`` words."""
    n = len(ids)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    yes = told[ids]
    first = np.flatnonzero(yes)
    text = np.searchsorted(starts, first, "right") - 1
    last = np.maximum.accumulate(np.where(yes, np.arange(n), -1))
    end = last[np.minimum(first + width, starts[text + 1]) - 1] + 1
    keep = end - first >= LEAST_WORDS
    return text[keep], first[keep], end[keep]


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[end] - total[first]


@dataclass
class Weights:
    """Inverse document frequency of each word number; 0 is a word beyond the vocabulary, as rare as any."""

    idf: np.ndarray

    @staticmethod
    def of(n_docs: int, df: np.ndarray) -> Weights:
        return Weights(np.log((n_docs + 1) / (np.concatenate([[0], df]) + 1)) + 1)

    def rows(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, weights), each passages x WINDOW: unit TF-IDF vectors with the square root of the count.

        A repeated word has its weight in parts; places beyond a passage and unknown words are word 0 without weight.
        """
        at = first[:, None] + np.arange(WINDOW)
        inside = at < end[:, None]
        words_ = np.where(inside, ids[np.minimum(at, len(ids) - 1)] if len(ids) else 0, 0)
        norm = np.sqrt((np.where(inside, self.idf[words_], 0) ** 2).sum(1))
        count = (words_[:, :, None] == words_[:, None, :]).sum(2)
        return words_, np.where(words_ > 0, self.idf[words_] / np.sqrt(count), 0) / np.maximum(norm, 1e-12)[:, None]


@dataclass
class Examples:
    """Labelled passages as word numbers, their marks and documents."""

    ids: list[np.ndarray] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)

    def add(self, ids: np.ndarray, mark: int, owner: int) -> None:
        self.ids.append(ids)
        self.marks.append(mark)
        self.owners.append(owner)


class Judge:
    """Scores passages by votes of the nearest examples.

    Equal examples are one neighbour, marked with the share of positive documents among those that have it: however many
    they are, they take one place among the neighbours and are one piece of evidence.
    """

    def __init__(self, examples: Examples, weights: Weights) -> None:
        self.weights = weights
        documents: dict[tuple[int, ...], dict[tuple[int, int], np.ndarray]] = defaultdict(dict)
        for x, mark, owner in zip(examples.ids, examples.marks, examples.owners, strict=True):
            documents[tuple(sorted(x.tolist()))].setdefault((owner, mark), x)
        # Those with positive documents first, like ones together, so that the blocks' bounds are tight.
        groups = [(max(m for _, m in d), sorted(x, key=lambda t: (-weights.idf[t], t)), x, d) for x, d in documents.items()]
        groups.sort(key=lambda g: (-g[0], g[1], g[2]))
        self.ids = [next(iter(d.values())) for *_, d in groups]
        self.people = np.unique(np.array(examples.owners, np.int64))
        of = [(g, o, m) for g, (*_, d) in enumerate(groups) for o, m in sorted(d)]
        group, owner, mark = np.array(of, np.int64).reshape(-1, 3).T
        self.votes = np.stack([np.bincount(group[mark == m], minlength=len(groups)) for m in (0, 1)], 1).astype(np.float64)
        self.marks = self.votes[:, 1] / np.maximum(self.votes.sum(1), 1)
        # A document's own votes are taken out by the key of (group, document).
        keys = group * (len(self.people) + 1) + np.searchsorted(self.people, owner)
        self.keys, at = np.unique(keys, return_inverse=True)
        self.own = np.zeros((len(self.keys) + 1, 2))
        np.add.at(self.own, (at, mark), 1)
        alone = np.bincount(self.keys // (len(self.people) + 1), minlength=len(groups)) == 1
        owners = np.full(len(groups), SHARED, np.int64)
        owners[group] = owner
        owners[~alone] = SHARED
        flat, sizes = np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.array([0, *map(len, self.ids)])
        at = np.cumsum(sizes)
        words_, values = weights.rows(flat, at[:-1], at[1:])
        used = np.unique(np.concatenate([[0], words_.ravel()]))
        self.row = np.zeros(len(weights.idf), np.int64)
        self.row[used] = np.arange(len(used))
        vectors: list[dict[int, float]] = []
        for ts, ws in zip(self.row[words_].tolist(), values.tolist(), strict=True):
            v: dict[int, float] = {}
            for t, w in zip(ts, ws, strict=True):
                if w:
                    v[t] = v.get(t, 0.0) + w
            vectors.append(v)
        self.index = BlockMaxIndex(vectors, len(used), owners)
        bounds = self.index.bounds[:, : -(-int((self.marks > 0).sum()) // BLOCK)]
        most = bounds.max(1) if bounds.size else np.zeros(len(used))
        self.most = np.where(self.row > 0, most[self.row], 0.0)
        self.told = self.most > 0

    def passages(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages whose cosine with some positive example can reach the radius: an upper bound, so none is lost."""
        text, first, end = windows(ids, starts, self.told)
        norm = np.sqrt(_sums(self.weights.idf[ids] ** 2, first, end))
        upper = _sums(self.weights.idf[ids] * self.most[ids], first, end)
        keep = upper >= (RADIUS - 1e-5) * norm
        return text[keep], first[keep], end[keep]

    def nearest(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words_, values = self.weights.rows(ids, first, end)
        return self.index.nearest(self.row[words_], values, NEIGHBOURS, RADIUS, docs)

    def voted(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(neighbours, their votes against, their votes for), each passages x NEIGHBOURS; a document does not vote on itself."""
        near, cos = self.nearest(ids, first, end, docs)
        people = np.minimum(np.searchsorted(self.people, docs), max(len(self.people) - 1, 0))
        key = near * (len(self.people) + 1) + people[:, None]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        own = np.where(((near >= 0) & (self.keys[at] == key) & (self.people[people] == docs)[:, None])[:, :, None], self.own[at], 0)
        votes = np.where((near >= 0)[:, :, None], self.votes[near], 0) - own
        share = votes / np.maximum(votes.sum(2, keepdims=True), 1)
        vote = 1 / (1 - np.minimum(cos, 1) + NEAR)
        return near, vote * share[:, :, 0], vote * share[:, :, 1]

    def scores(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(raw score, nearest example of a positive document or -1) of each passage."""
        if not len(self.ids):
            return np.zeros(len(first)), np.full(len(first), -1, np.int64)
        near, against, in_favour = self.voted(ids, first, end, docs)
        raw = in_favour.sum(1) / ((against + in_favour).sum(1) + DOUBT)
        positive = in_favour > 0
        return raw, np.where(positive.any(1), near[np.arange(len(near)), positive.argmax(1)], -1)


@dataclass
class Fit:
    """What the executors need: vocabulary, words that may be masked or spelt in digits, weights and examples."""

    vocabulary: list[str]
    evident: frozenset[str]
    weights: Weights
    examples: Examples

    def numbers(self) -> Numbers:
        return Numbers({w: i + 1 for i, w in enumerate(self.vocabulary)}, Spelling(self.evident))


def _distinct_counts(ids: np.ndarray, starts: np.ndarray, n_words: int) -> np.ndarray:
    """In how many of the texts each word number occurs."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = np.unique(text * (n_words + 1) + ids)
    return np.bincount(pairs % (n_words + 1), minlength=n_words + 1)


def _edited(examples: Examples, weights: Weights) -> Examples:
    """``examples`` without positive ones whose neighbours in other documents outvote them, and negatives near those only."""
    out = Examples()
    if not examples.ids:
        return out
    ids, marks, owners = examples.ids, np.array(examples.marks), np.array(examples.owners, np.int64)

    def ends(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(ids[i]) for i in some])]).astype(np.int64)
        return np.concatenate([ids[i] for i in some]), at[:-1], at[1:]

    loud, calm = np.flatnonzero(marks > 0), np.flatnonzero(marks == 0)
    if len(loud):
        _, against, in_favour = Judge(examples, weights).voted(*ends(loud), owners[loud])
        for i in loud[in_favour.sum(1) >= against.sum(1)]:
            out.add(ids[i], 1, int(owners[i]))
    if len(calm) and out.ids:
        near, _ = Judge(out, weights).nearest(*ends(calm), np.full(len(calm), -1))
        for i in calm[near[:, 0] >= 0]:
            out.add(ids[i], 0, int(owners[i]))
    return out


def fit(reviewed: list[tuple[int, str, int]], n_docs: int, df: dict[str, int]) -> Fit:
    """Examples from (document, text, mark) of reviewed documents; ``df`` counts the words of all ``n_docs`` documents.

    A word is evidence by its log odds in positive documents against the rest of the corpus, two standard errors below
    the estimate. Each positive document gives its window of most evidence and further disjoint ones of nearly as much;
    each negative one its nearest window to every positive example within the radius. Positive examples that neighbours
    of other documents outvote are dropped.
    """
    number: dict[str, int] = {}
    plain = Numbers(number, Spelling(), grow=True)
    marks = np.array([m for _, _, m in reviewed], bool)
    ids, starts = numbered(pa.array([t for _, t, _ in reviewed], pa.string()), plain)
    positive = [ids[a:b] for a, b, m in zip(starts, starts[1:], marks, strict=False) if m]
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in positive])]).astype(np.int64)
    p = _distinct_counts(np.concatenate([*positive, np.zeros(0, np.int64)]), sizes, len(number))[1:].astype(float)
    total = np.array([df.get(w, 0) for w in number], float)
    rest, n_rest = np.maximum(total - p, 0), max(n_docs - len(positive), 0)
    odds = np.log((p + 0.5) / (len(positive) + 1)) - np.log((rest + 0.5) / (n_rest + 1))
    evidence = np.where((total >= 2) & (p > 0), np.maximum(odds - 2 * np.sqrt(1 / (p + 0.5) + 1 / (rest + 0.5)), 0), 0)
    evident = frozenset(w for w, e in zip(number, evidence, strict=True) if e > 0)
    ids, starts = numbered(pa.array([t for _, t, _ in reviewed], pa.string()), Numbers(number, Spelling(evident), grow=True))
    total = np.concatenate([total, [df.get(w, 0) for w in list(number)[len(total) :]]])
    evidence = np.concatenate([[0.0], evidence, np.zeros(len(number) - len(evidence))])
    weights = Weights.of(n_docs, total)
    text, first, end = windows(ids, starts, evidence > 0)
    examples = Examples()
    amount = _sums(evidence[ids], first, end)
    for d in np.flatnonzero(marks):
        lo, hi = np.searchsorted(text, [d, d + 1])
        taken: list[int] = []
        best = amount[lo:hi].max(initial=0)
        for i in lo + np.argsort(-amount[lo:hi], kind="stable"):
            if amount[i] < FURTHER * best:
                break
            if all(end[i] <= first[j] or end[j] <= first[i] for j in taken):
                taken.append(i)
                examples.add(ids[first[i] : end[i]], 1, reviewed[d][0])
    judge = Judge(examples, weights)
    text, first, end = judge.passages(ids, starts)
    calm = ~marks[text]
    text, first, end = text[calm], first[calm], end[calm]
    near, cos = judge.nearest(ids, first, end, np.full(len(first), -1))
    closest: dict[tuple[int, int], tuple[float, int]] = {}
    for i in range(len(first)):
        if near[i, 0] >= 0:
            key = (int(text[i]), int(near[i, 0]))
            closest[key] = max(closest.get(key, (0.0, -len(first))), (float(cos[i, 0]), -i))
    for (d, _), (_, i) in sorted(closest.items()):
        examples.add(ids[first[-i] : end[-i]], 0, reviewed[d][0])
    return Fit(list(number), evident, weights, _edited(examples, weights))


def reviewed_documents(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_DOCS) -> list[tuple[int, str, int]]:
    """(doc_id, text, mark) of at most ``limit`` reviewed documents, drawn by hash; the latest review of each counts."""
    last = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("reviewed_at"), F.desc("toxic"))
    marks = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic", "reviewed_at")
    marks = marks.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("doc_id", "toxic")
    drawn = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text, int(r.toxic > 0)) for r in rows.collect())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches cut to about CHUNK bytes of text, or one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def document_frequencies(documents: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(documents, in how many each word of ``vocabulary`` occurs) over all of them; only the counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers({w: i + 1 for i, w in enumerate(vocabulary)}, Spelling())
        counts = np.zeros(len(vocabulary) + 1, np.int64)
        n = 0
        for _, texts in _chunks(batches):
            n += len(texts)
            counts += _distinct_counts(*numbered(texts, numbers), len(vocabulary))
        counts[0] = n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["word", "n"])

    rows = documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "word bigint, n bigint")
    found = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(0, 0), {vocabulary[i - 1]: n for i, n in found.items()}


def raw_scores(documents: DataFrame, model: Fit) -> DataFrame:
    """(doc_id, raw, passage, example) of documents with a passage that has a positive neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, judge = model.numbers(), Judge(model.examples, model.weights)
        name = np.array(["…", *model.vocabulary], object)
        told = [" ".join(name[x]) for x in judge.ids]
        for docs, texts in _chunks(batches):
            ids, starts = numbered(texts, numbers)
            text, first, end = judge.passages(ids, starts)
            keys = docs.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = []
            for lo in range(0, len(text), PASSAGES):
                t, f, e = text[lo : lo + PASSAGES], first[lo : lo + PASSAGES], end[lo : lo + PASSAGES]
                raw, near = judge.scores(ids, f, e, keys[t])
                order = np.lexsort((np.arange(len(t)), -raw, t))
                order = order[np.unique(t[order], return_index=True)[1]]  # the worst passage of each document
                for i in order[raw[order] > 0].tolist():
                    rows.append((int(keys[t[i]]), float(raw[i]), " ".join(name[ids[f[i] : e[i]]]), told[near[i]]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (docs.type, pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "raw", "passage", "example"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, raw double, passage string, example string")
    worst = rows.groupBy("doc_id").agg(F.max(F.struct("raw", "passage", "example")).alias("w"))
    return worst.select("doc_id", "w.raw", "w.passage", "w.example")


def calibration(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Steps (from raw score, probability) of the isotonic regression of marks on raw scores.

    Each step is drawn towards its mean raw score by ``PRIOR`` documents, so few reviewed documents leave it raw.
    """
    blocks: list[list[float]] = []  # least score, sum of scores, sum of marks, number
    for s, m in sorted(points):
        if blocks and s == blocks[-1][0]:
            blocks[-1][1:] = [blocks[-1][1] + s, blocks[-1][2] + m, blocks[-1][3] + 1]
        else:
            blocks.append([s, s, float(m), 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, s2, m2, n2 = blocks.pop()
            blocks[-1][1:] = [blocks[-1][1] + s2, blocks[-1][2] + m2, blocks[-1][3] + n2]
    out, top = [], 0.0
    for least, s, m, n in blocks:
        top = max(top, (m + PRIOR * s / n) / (n + PRIOR))
        out.append((least, top))
    return out


def refused_examples(found: dict[str, tuple[int, int, int, float]], others: tuple[int, int, int]) -> set[str]:
    """Examples of ``found`` whose documents reviewers marked as they mark ordinary documents, not toxic ones.

    Both give (documents, of them marked, of them marked toxic): ``found`` of those an example brought above one half, with
    their mean raw score, ``others`` of all the rest. The raw score is what they are believed to be before the marks are seen. A mark given by mistake makes an example that no other marked document is near: the more
    documents it brings in, the less likely that is if they are toxic. The rate of toxic ones is that of all examples not
    refused, so it tells nothing where reviewers drew toxic documents no more often than others.
    """

    def rates(rows: list[tuple[int, int, int]]) -> np.ndarray:
        docs, marked, toxic = np.array([(0, 0, 0), *rows], float).sum(0)
        return (np.maximum([toxic, marked - toxic, docs - marked], 0) + 0.5) / (max(docs, 0) + 1.5)

    ordinary, out = rates([others]), set()
    while True:
        ratio = np.log(rates([v[:3] for e, v in found.items() if e not in out]) / ordinary)
        ratio[0] = max(ratio[0], 0.0)  # a toxic mark never speaks against an example
        more = {e for e, (d, m, t, raw) in found.items() if e not in out and np.dot(ratio, [t, m - t, d - m]) + math.log(raw / (1 - raw)) < -math.log(REFUSED)}
        if not more:
            return out
        out |= more


def without(model: Fit, refused: set[str]) -> Fit:
    """``model`` without the positive examples named in ``refused``."""
    name = np.array(["…", *model.vocabulary], object)
    judge = Judge(model.examples, model.weights)
    gone = {tuple(sorted(x.tolist())) for x in judge.ids if " ".join(name[x]) in refused}
    kept = Examples()
    for x, mark, owner in zip(model.examples.ids, model.examples.marks, model.examples.owners, strict=True):
        if not (mark and tuple(sorted(x.tolist())) in gone):
            kept.add(x, mark, owner)
    return Fit(model.vocabulary, model.evident, model.weights, kept)


def _calibrated(raw: Column, steps: list[tuple[float, float]]) -> Column:
    out = raw if not steps else F.least(raw, F.lit(steps[0][1]))
    for least, probability in steps:
        out = F.when(raw >= least, F.lit(probability)).otherwise(out)
    return out


def judged(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_DOCS) -> DataFrame:
    """(doc_id, score, passage, example) of documents with a passage that has a positive neighbour.

    ``score`` is the calibrated probability, ``passage`` the worst one in canonical words (… for words no reviewed
    document has), ``example`` its nearest positive example. Reviewed documents are judged without their own passages.
    Other documents have score 0 and no row. Without reviewed positives there is no row at all. Examples that the marks of
    the documents they bring in refute are refused, and all near documents judged again, until none is left.
    """
    reviewed = reviewed_documents(documents, labels, limit)
    number: dict[str, int] = {}
    numbered(pa.array([t for _, t, _ in reviewed], pa.string()), Numbers(number, Spelling(), grow=True))
    n_docs, df = document_frequencies(documents, list(number))
    model = fit(reviewed, n_docs, df)
    scored = materialize(raw_scores(documents, model))
    marks = documents.sparkSession.createDataFrame([(d, m) for d, _, m in reviewed], f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, mark int")
    near = None
    while True:
        points = scored.join(F.broadcast(marks), "doc_id").select("raw", "mark").collect()  # reviewed documents only
        steps = calibration([(r.raw, r.mark) for r in points])
        told = scored.withColumn("score", _calibrated(F.col("raw"), steps))
        marked = told.filter("score >= 0.5").join(F.broadcast(marks), "doc_id", "left").groupBy("example")
        counts = marked.agg(F.count(F.lit(1)).alias("d"), F.count("mark").alias("m"), F.coalesce(F.sum("mark"), F.lit(0)).alias("t"), F.avg("raw").alias("raw")).collect()
        found = {r.example: (r.d, r.m, r.t, r.raw) for r in counts}
        d, m, t = (sum(v[i] for v in found.values()) for i in range(3))
        refused = refused_examples(found, (n_docs - d, len(reviewed) - m, sum(r[2] for r in reviewed) - t))
        if not refused:
            return told.select("doc_id", "score", "passage", "example")
        model = without(model, refused)
        if near is None:  # only documents near some positive example can change; the texts are never shuffled
            asked, small = checked_broadcast(scored.select("doc_id"), NEAR_ROWS)
            near = documents.join(asked, "doc_id", "left_semi") if small else documents
        scored = materialize(raw_scores(near, model))


def toxic_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, passage, example) of the documents that are more likely toxic than not."""
    return judged(documents, labels).filter("score >= 0.5")


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, toxic) of every document, null and empty texts included (score 0)."""
    scores = judged(documents, labels).select("doc_id", "score")
    score = F.coalesce("score", F.lit(0.0))
    rows = documents.select("doc_id", "source").join(scores, "doc_id", "left")
    return rows.select("doc_id", "source", F.round(score, 6).alias("score"), (score >= 0.5).alias("toxic"))


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, n_toxic, rate) per source."""
    out = scored_documents(documents, labels).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))
    return out.withColumn("rate", F.round(F.col("n_toxic") / F.col("n_docs"), 6))
