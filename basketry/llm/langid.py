"""Language identification by segmentation-marginalised unigrams.

Each language is a unigram distribution over the pieces of a fixed public
vocabulary.  A word's probability under a language is the sum, over all ways
to cut it into pieces, of the product of the piece probabilities; the forward
algorithm adds them up in one pass.  A text's log-likelihood is the sum over
its words, and the score of the predicted language is its posterior under
equal priors.

Learning takes the piece probabilities from labelled documents by expectation
maximisation: expected piece counts from the forward-backward sums of each
word, weighted by how often the language has it.  The classifier is fitted on
a bounded sample (``SAMPLE_DOCS`` documents a language, chosen by a hash of
the id); prediction covers every row.
"""

from __future__ import annotations

import math
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Recent, held, quoted, written

#: Bound of the training sample: labelled documents of each language.
SAMPLE_DOCS = 1000
EM_ROUNDS = 2
#: Mass, in words, of the pooled distribution that smooths each language.
SMOOTH = 50.0
#: A text fits its language if the mean log-likelihood of its words is less
#: than so many standard deviations (of single words) below the sample's mean.
FIT = 3.0
#: Probability of a character that no piece of the vocabulary covers.
UNKNOWN = 1e-7
#: Words up to this length are kept in a worker's tables, and the bytes that
#: these tables may take for the values that they hold.
SHORT, CACHE_BYTES = 40, 128 << 20
#: Words whose sums advance together, and letters of text looked up together.
BLOCK, BLOCK_CHARS = 4096, 1 << 20
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"


def words_of(text: str | None) -> list[str]:
    """Runs of letters (with their marks), composed and in lower case."""
    return WORD.findall(unicodedata.normalize("NFC", text or "").lower())


def letter_pieces(model_file: str) -> list[str]:
    """The vocabulary's pieces that can be part of a word: letters in lower
    case, with or without the mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in found if p == START or ((w := p.removeprefix(START)) == w.lower() and WORD.fullmatch(w)))


def trie_of(pieces: list[str]) -> dict:
    """Nested dictionaries by character; key "" holds the piece's number."""
    root: dict = {}
    for i, p in enumerate(pieces):
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = i
    return root


def arcs_of(word: str, trie: dict) -> list[list[tuple[int, int]]]:
    """For each start in the marked word: (end, piece) of all pieces that fit
    there; (start + 1, -1) where no single character does."""
    text = START + word
    out = []
    for i in range(len(text)):
        node, here, single = trie, [], False
        for j in range(i, len(text)):
            if (node := node.get(text[j])) is None:
                break
            if "" in node:
                here.append((j + 1, node[""]))
                single = single or j == i
        if not single:
            here.append((i + 1, -1))
        out.append(here)
    return out


def expected(word: str, trie: dict, p: list[float] | None, weight: float, into: Counter) -> None:
    """Add the word's expected piece counts; ``p`` None: each piece that fits
    anywhere counts once."""
    arcs = arcs_of(word, trie)
    if p is None:
        into.update({k: 0 for here in arcs for _, k in here if k >= 0})
        for here in arcs:
            for _, k in here:
                if k >= 0:
                    into[k] += weight
        return
    n = len(arcs)
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, here in enumerate(arcs):
        for j, k in here:
            ahead[j] += ahead[i] * (p[k] if k >= 0 else UNKNOWN)
    for i in range(n - 1, -1, -1):
        behind[i] = sum(behind[j] * (p[k] if k >= 0 else UNKNOWN) for j, k in arcs[i])
    if (total := ahead[n]) <= 0:
        return
    for i, here in enumerate(arcs):
        for j, k in here:
            if k >= 0:
                into[k] += weight * ahead[i] * p[k] * behind[j] / total


@dataclass
class Model:
    """Languages, pieces, and probs[piece] = one probability a language."""

    langs: list[str]
    pieces: list[str]
    probs: list[tuple[float, ...]]
    #: For each language the least mean log-likelihood of a text's words that fits it.
    least: list[float] = field(default_factory=list)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Log-likelihoods of words and texts under each language."""

    def __init__(self, model: Model):
        self.model, self.trie = model, trie_of(model.pieces)
        self.n = len(model.langs)
        self.unknown = (UNKNOWN,) * self.n
        # The last row serves characters that no piece covers.
        self.probs = np.array([*model.probs, self.unknown], np.float64).reshape(len(model.probs) + 1, self.n)
        # A packed value takes its numbers, a key and the places of both; the
        # tables of words and of pieces share the values of plain words.
        entries = CACHE_BYTES // (8 * (self.n + 1) + 300)
        self.words_seen, self.pieces_seen = Recent(entries), Recent(entries)

    def word(self, word: str) -> list[float]:
        """Forward algorithm over all segmentations, one sum a language.
        Long words are rescaled on the way, so that no sum underflows."""
        arcs = arcs_of(word, self.trie)
        probs, none = self.model.probs, [0.0] * self.n
        ahead: list[list[float]] = [[1.0] * self.n] + [none] * len(arcs)
        shift = [0.0] * self.n
        for i, here in enumerate(arcs):
            now = ahead[i]
            if i % 16 == 15 and min(now) < 1e-60:
                reach = max(j for back in arcs[max(0, i - 40) : i] for j, _ in back)
                scale = [1.0 / x if x > 0 else 1.0 for x in now]
                shift = [s - math.log(x) for s, x in zip(shift, scale)]
                for j in range(i, min(reach, len(arcs)) + 1):
                    ahead[j] = [x * s for x, s in zip(ahead[j], scale)]
                now = ahead[i]
            for j, k in here:
                ahead[j] = [x + y * q for x, y, q in zip(ahead[j], now, probs[k] if k >= 0 else self.unknown)]
        return [math.log(x) + s if x > 0 else -1e9 for x, s in zip(ahead[-1], shift)]

    def words(self, words: list[str]) -> list[list[float]]:
        """The same for many words of at most ``SHORT`` letters together: the
        forward sums of all of them advance from one start to the next."""
        trie, none, arcs = self.trie, len(self.model.pieces), []
        add, size = arcs.append, np.zeros(len(words), np.int64)
        for w, word in enumerate(words):
            text = START + word
            size[w] = n = len(text)
            for i in range(n):
                base, node, single = (w << 6 | i) << 22, trie, False
                for j in range(i, n):
                    if (node := node.get(text[j])) is None:
                        break
                    if (k := node.get("")) is not None:
                        add(base + (j + 1 << 16 | k))
                        single = single or j == i
                if not single:
                    add(base + (i + 1 << 16 | none))
        flat = np.array(arcs, np.int64)
        flat = flat[np.argsort(flat >> 22 & 63, kind="stable")]
        start, end, piece, of = flat >> 22 & 63, flat >> 16 & 63, flat & 0xFFFF, flat >> 28
        ahead = np.zeros((len(words), SHORT + 2, self.n))
        ahead[:, 0] = 1.0
        cuts = np.searchsorted(start, np.arange(SHORT + 2))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < z:  # of one word and start all ends differ
                ahead[of[a:z], end[a:z]] += ahead[of[a:z], start[a:z]] * self.probs[piece[a:z]]
        total = ahead[np.arange(len(words)), size]
        low = (total <= 1e-290).any(axis=1)
        out = np.log(np.maximum(total, 1e-300)).tolist()
        for w in np.flatnonzero(low).tolist():
            out[w] = self.word(words[w])
        return out

    def learn_pieces(self, pieces: set[str]) -> list[str]:
        """What stands between white space: packed log-likelihoods and number
        of words.  Returns those that are too long to be kept on."""
        new = self.pieces_seen.lacking(pieces)
        parts = {p: WORD.findall(p) for p in new}
        words = {w for ws in parts.values() for w in ws}
        fresh = sorted(self.words_seen.lacking(words))
        seen = self.words_seen
        code = struct.Struct(f"{self.n + 1}d")
        pack = code.pack
        long = [w for w in fresh if len(w) > SHORT]
        seen.update({w: pack(*self.word(w), 1.0) for w in long})
        short = [w for w in fresh if len(w) <= SHORT]
        for a in range(0, len(short), BLOCK):
            seen.update(zip(short[a : a + BLOCK], [pack(*x, 1.0) for x in self.words(short[a : a + BLOCK])]))
        none = pack(*(0.0,) * (self.n + 1))
        for p, ws in parts.items():
            if len(ws) == 1:
                self.pieces_seen[p] = seen[ws[0]]
            else:
                self.pieces_seen[p] = pack(*map(sum, zip(*(code.unpack(seen[w]) for w in ws)))) if ws else none
        for w in long:
            del seen[w]
        return [p for p in new if len(p) > SHORT]

    def texts(self, texts: pa.Array) -> list[tuple[str, float, float]]:
        """(language, score, mean log-likelihood of a word in this language) of
        each text, over the whole of it."""
        if not self.n:
            return [("und", 0.0, 0.0)] * len(texts)
        out: list[tuple[str, float, float]] = []
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < BLOCK_CHARS):
                text = texts[at].as_py() or ""
                cut.append(unicodedata.normalize("NFC", text).lower().split())
                size += len(text)
                at += 1
            long = self.learn_pieces(set().union(*cut))
            out += [self._decide(b"".join(map(self.pieces_seen.__getitem__, pieces))) for pieces in cut]
            for p in long:
                del self.pieces_seen[p]
        return out

    def _decide(self, packed: bytes) -> tuple[str, float, float]:
        total = np.frombuffer(packed, np.float64).reshape(-1, self.n + 1).sum(axis=0)
        if not total[self.n]:
            return "und", 0.0, 0.0
        s = total[: self.n]
        best = int(s.argmax())  # the first of equals
        return self.model.langs[best], round(float(1.0 / np.exp(np.minimum(s - s[best], 0)).sum()), 9), float(s[best] / total[self.n])

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.texts(pa.array([text], pa.string()))[0][:2]


def scorer_of(model: Model) -> Scorer:
    """One scorer a Python worker and model."""
    return held(("langid", model.key), lambda: Scorer(model))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(quoted(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from the documents that are not held out and have an id, a
    language and a text.  The sample of each language holds about
    ``sample_docs`` documents: those whose hashed id is below a bound that
    follows from the language's count.  What reaches the driver is bounded by
    pieces x languages."""
    pieces = letter_pieces(model_file)
    docs = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"))
    docs = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], pieces, [()] * len(pieces))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, sample_docs / sizes[g])))])
    sample = docs.where(place < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for g, t in zip(b.column(0).to_pylist(), b.column(1)):
                found.update((g, w) for w in words_of(t.as_py()) if len(w) <= SHORT)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(found.values(), pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    probs: dict[str, list[float]] | None = None
    for _ in range(1 + EM_ROUNDS):
        got = {g: np.zeros(len(pieces)) for g in langs}
        for r in _expectation(words, pieces, probs).collect():
            got[r["lang"]][r["piece"]] = r["n"]
        pooled = sum(got.values()) + 1.0
        pooled /= pooled.sum()
        # Smoothed as the learned counts of each language are few for rare pieces.
        probs = {g: ((c + SMOOTH * pooled) / (c.sum() + SMOOTH)).tolist() for g, c in got.items()}
    model = Model(langs, pieces, [tuple(probs[g][i] for g in langs) for i in range(len(pieces))])
    level = {r["lang"]: r for r in _levels(words, model).collect()}
    for g in langs:
        n, s, s2 = (level[g][c] for c in ("n", "s", "s2")) if g in level else (0, 0.0, 0.0)
        mean = s / max(n, 1)
        model.least.append(mean - FIT * math.sqrt(max(s2 / max(n, 1) - mean * mean, 0.0)) if n else -math.inf)
    return model


def _levels(words: DataFrame, model: Model) -> DataFrame:
    """Per language: count, sum and sum of squares of the log-likelihoods of
    the sample's words under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, at = scorer_of(model), {g: i for i, g in enumerate(model.langs)}
        for b in batches:
            of, words, n = (c.to_pylist() for c in b.columns)
            got = [scores[at[g]] for g, scores in zip(of, scorer.words(words))] if words else []
            sums = [pa.array([k * x**e for k, x in zip(n, got)], pa.float64()) for e in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *sums], names=["lang", "n", "s", "s2"])

    scored = words.select("lang", "word", "n").mapInArrow(run, "lang string, n long, s double, s2 double")
    return scored.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])


def _expectation(words: DataFrame, pieces: list[str], probs: dict[str, list[float]] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, found = trie_of(pieces), {}
        for b in batches:
            for g, w, n in zip(*(c.to_pylist() for c in b.columns)):
                expected(w, trie, probs and probs[g], float(n), found.setdefault(g, Counter()))
        rows = [(g, k, v) for g, c in found.items() for k, v in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())],
            names=["lang", "piece", "n"],
        )

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", fits: str | None = None) -> DataFrame:
    """All columns of ``df`` and, from the text alone, ``lang_pred``,
    ``score`` and, if named, ``fits`` (whether the words are as likely as those
    of the language's sample, by their mean).  A null text or one without a
    letter gives 'und', 0 and false, and so does a model that has learned no
    language.  Every row stays; columns of the new names, in any case, are
    replaced."""
    new = {c.lower() for c in (lang_pred, score, fits) if c}
    keep = [c for c in df.columns if c.lower() not in new]
    fields = [f for f in df.schema.fields if f.name in keep]
    # a text that stays is sent once
    at, own = (keep.index(text), []) if text in keep else (len(keep), [quoted(text).alias("src")])
    inner = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], *own)
    flat = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(fields)) + "lang_pred string, score double, fits boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        least = dict(zip(model.langs, model.least))
        for b in batches:
            got = scorer.texts(b.column(at))
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            made.append(pa.array([g != "und" and mean >= least.get(g, -math.inf) for g, _, mean in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*b.schema.names[: len(keep)], "lang_pred", "score", "fits"])

    out = inner.mapInArrow(run, flat)
    return (out if fits else out.drop("fits")).toDF(*keep, lang_pred, score, *([fits] if fits else []))


def identify(df: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model is learned
    from the rows that are not held out."""
    model = fit(df, model_file, doc_id, text, lang)
    docs = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(df: DataFrame, model_file: str, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` with a predicted language whose score is at least
    ``least`` and which the words fit; 'und' goes, and so do texts of no learned
    language and strings of letters.  All columns stay as they are."""
    model = fit(df, model_file, doc_id, text, lang)
    names = [f"c{i}" for i in range(len(df.columns))]
    at = next(n for n, c in zip(names, df.columns) if c.lower() == text.lower())
    out = predict(df.toDF(*names), model, at, "lang_pred", "score", "fits")
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & F.col("fits")).select(*names).toDF(*df.columns)
