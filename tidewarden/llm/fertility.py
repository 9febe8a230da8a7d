"""Quality rules from tokeniser fertility.

A public vocabulary is run over every word of a text. Characters per token, tokens per word, the share of tokens
that are byte fallbacks and the entropy of the tokens are held against bands for the text's
language (or script) and length. The bands come from the quartiles of all documents that pass the plain rules, so they need no labels and
junk among the documents doesn't move them. Plain counts (word characters, symbols, repeated lines and words) come from
the same pass, which is one narrow transformation with the memory of one chunk of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K

MEASURES = (
    "doc_id long, kind string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, tokens_per_word double, byte_share double, token_entropy double, base_failed boolean"
)


@dataclass(frozen=True)
class Band:
    """How far a measure may lie from its median, in distances between the median and a quartile of at least ``floor``: ``below``, by the
    upper quartile, and ``above``, by the lower one. The quartile on the other side of junk is used, which junk doesn't move."""

    below: float | None
    above: float | None
    floor: float


#: Clean prose of 50 words or more lies inside, as measured on the labelled rows of the test tables (see README).
BANDS = {"chars_per_token": Band(7.0, 15.0, 0.01), "tokens_per_word": Band(15.0, 10.0, 0.02), "token_entropy": Band(6.0, None, 0.05)}

#: Byte fallbacks are rare where a vocabulary covers the script: a fixed bound beside the language's median.
MOST_BYTES = 0.1

_SHORTEST, _LONGEST = 5, 10  # classes of length: whole log2 of the number of words
#: A class of fewer documents takes the bands of its whole language, and a language of fewer has none.
LEAST_DOCUMENTS = 40

# first code points of scripts
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_SCRIPT_STARTS = np.array([a for a, _ in _SCRIPTS])


def script_of(text: bytes) -> str:
    """The script of most letters of a text, kana before han; a text without letters is latin."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    letters = points[(points >= 0x80) | ((points | 0x20) - 0x61 < 26)]
    count = np.bincount(np.searchsorted(_SCRIPT_STARTS, letters, "right") - 1, minlength=len(_SCRIPTS))
    by_name: dict[str, int] = {}
    for (_, name), n in zip(_SCRIPTS, count.tolist(), strict=True):
        by_name[name] = by_name.get(name, 0) + n
    if by_name["kana"] * 10 > len(letters) > 0:
        return "kana"
    return max(by_name, key=lambda k: by_name[k])


_CONTINUATION = np.zeros(256, bool)
_CONTINUATION[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class WordTokens:
    """Token ids of words, each encoded once; at most ``most`` words are remembered."""

    def __init__(self, model: str, most: int = 100_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.known: dict[int, np.ndarray] = {}
        self.most = most

    def lookup(self, keys: np.ndarray, words: list[bytes]) -> list[np.ndarray]:
        new = [i for i, k in enumerate(keys.tolist()) if k not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(range(len(keys)))
        for i, ids in zip(new, self.model.encode([words[i].decode("utf-8", "replace") for i in new], num_threads=1), strict=True):
            self.known[int(keys[i])] = np.array(ids, np.int32)
        return [self.known[k] for k in keys.tolist()]


def _sum_by(owner: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(owner, weights, minlength=n)


def measure(texts: list[bytes], tokens: WordTokens) -> dict[str, np.ndarray]:
    """The measures of a chunk of texts."""
    c, n = K.Chunk.of(texts), len(texts)
    start, end, owner = c.words()
    sizes = c.end - c.start
    byte_owner = np.repeat(np.arange(n), sizes)
    chars = ~_CONTINUATION[c.buf] & ~K.SPACE[c.buf]
    out = {
        "n_words": _sum_by(owner, None, n),
        "word_chars": _sum_by(byte_owner[chars], None, n),
        "n_symbols": _sum_by(byte_owner[_SYMBOL[c.buf]], None, n),
    }
    # repeated lines: a line with a word that equals an earlier line of the same text
    pre = K.prefix(c.byte_values(), 0)
    breaks = np.flatnonzero(c.buf == 10)
    line_start = np.sort(np.concatenate([c.start[sizes > 0], breaks + 1]))
    line_start = line_start[line_start < len(c.buf)]
    line_start = line_start[np.append(True, line_start[1:] != line_start[:-1])[: len(line_start)]]
    if len(line_start):
        line_owner = c.owner(line_start)
        nxt = np.append(breaks, len(c.buf))
        line_end = np.minimum(nxt[np.searchsorted(nxt, line_start)], c.end[line_owner])
        has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        line_start, line_end, line_owner = line_start[has_word], line_end[has_word], line_owner[has_word]
        h = K.spans_hash(pre, line_start, line_end, 0)
        order = np.lexsort((h, line_owner))
        a, b = line_owner[order], h[order]
        again = a[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        out["n_dup_lines"] = _sum_by(again, None, n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    # words in three-word windows that the text has twice
    h = K.spans_hash(pre, start, end, 0)
    inside = np.flatnonzero(K.same_owner(owner, 3))
    grams = K.windows_hash(h, 3, 1)[inside] if len(inside) else np.zeros(0, np.uint64)
    order = np.lexsort((grams, owner[inside]))
    a, o = grams[order], owner[inside][order]
    same = np.zeros(len(a), bool)
    if len(a) > 1:
        eq = (a[1:] == a[:-1]) & (o[1:] == o[:-1])
        same[1:] |= eq
        same[:-1] |= eq
    out["n_repeat_words"] = _sum_by(owner[K.covered(len(start), inside[order[same]], 3)], None, n)
    # tokens, by distinct word
    uniq, place = K.unique_inverse(h)
    first = np.empty(len(uniq), np.int64)
    first[place] = np.arange(len(place))
    buf = c.buf.tobytes()
    ids = tokens.lookup(uniq, [buf[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    at = np.cumsum(length) - length
    per_word = length[place]
    token_owner = np.repeat(owner, per_word)
    shift = np.repeat(at[place] - (np.cumsum(per_word) - per_word), per_word)
    stream = flat[np.arange(int(per_word.sum())) + shift]
    out["n_tokens"] = _sum_by(token_owner, None, n)
    out["n_bytes"] = _sum_by(token_owner[tokens.is_byte[stream]], None, n)
    pairs, count = K.unique_counts(token_owner * len(tokens.is_byte) + stream)
    own = pairs // len(tokens.is_byte)
    share = count / out["n_tokens"][own]
    out["token_entropy"] = _sum_by(own, -share * np.log2(share), n)
    return out


def measures(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """MEASURES of every row; kind is its language or, where that is null or empty, its script."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), lang.alias("lang"))

    def run(batches):
        tokens = WordTokens(model_path)
        for batch in batches:
            ids, texts, langs = (c.to_pylist() for c in batch.columns)
            texts = [t or b"" for t in texts]
            for at, part in K.chunks(texts):
                m = measure(part, tokens)
                to, words, n_tokens = at + len(part), m["n_words"], np.maximum(m["n_tokens"], 1)
                kind = [lg or f"script {script_of(t)}" for lg, t in zip(langs[at:to], part, strict=True)]
                counts = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
                ratios = [pa.array(x) for x in (m["word_chars"] / n_tokens, m["n_tokens"] / np.maximum(words, 1), m["n_bytes"] / n_tokens, m["token_entropy"] + 0.0)]
                failed = (words < least_words) | (100 * m["n_repeat_words"] > most_repeat_percent * words)
                columns = [pa.array(ids[at:to], pa.int64()), pa.array(kind, pa.string()), *counts, *ratios, pa.array(failed)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MEASURES.split(", ")])

    return rows.mapInArrow(run, MEASURES)


def _length_class(words: Column) -> Column:
    return F.greatest(F.least(F.floor(F.log2(F.greatest(words, F.lit(1)))).cast("int"), F.lit(_LONGEST)), F.lit(_SHORTEST))


def fit_bands(measured: DataFrame, bands: dict[str, Band] | None = None) -> DataFrame:
    """(kind, length, documents, and low_ and high_ of every measure) by kind and length, and by kind alone (length null).

    Quartiles are exact, over all documents that pass the plain rules, of values rounded to three digits: their number is bounded, and so is the
    memory of a group, however many documents it has. Partial counts of the values are merged before the shuffle.
    """
    bands = BANDS if bands is None else bands
    rows = measured.where(~F.col("base_failed")).select("kind", _length_class(F.col("n_words")).alias("length"), *[F.round(m, 3).alias(m) for m in [*bands, "byte_share"]])
    quartiles = {m: F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for m in [*bands, "byte_share"]}
    out = None
    for keys in (["kind", "length"], ["kind"]):
        found = rows.groupBy(*keys).agg(F.count("*").alias("documents"), *[q.alias(m) for m, q in quartiles.items()]).where(F.col("documents") >= LEAST_DOCUMENTS)
        limits = [(F.get("byte_share", F.lit(1)) + MOST_BYTES).alias("high_byte_share")]
        for m, b in bands.items():
            low, mid, high = (F.get(m, F.lit(i)) for i in range(3))
            limits.append((mid - b.below * F.greatest(high - mid, F.lit(b.floor)) if b.below else F.lit(None).cast("double")).alias(f"low_{m}"))
            limits.append((mid + b.above * F.greatest(mid - low, F.lit(b.floor)) if b.above else F.lit(None).cast("double")).alias(f"high_{m}"))
        one = found.select("kind", (F.col("length") if len(keys) > 1 else F.lit(None).cast("int")).alias("length"), "documents", *limits)
        out = one if out is None else out.unionByName(one)
    return out


def quality_rules(docs: DataFrame, model_path: str, bands: dict[str, Band] | None = None, **options) -> DataFrame:
    """MEASURES and the verdict (rejected_by, kept) of every row.

    Words are maximal runs of bytes other than ASCII white space; a word that repeats counts each
    time. base_failed: fewer than ``least_words`` words, or more than ``most_repeat_percent`` percent
    of them in three-word windows that occur twice. kept: not base_failed and inside the bands that fit_bands() finds for the
    row's language (or script) and length. rejected_by names the first failing measure. Null or empty text: no words,
    base_failed. A table without a language column goes by scripts. Repeated rows each get their row; an empty table gives none. Options are those of measures().
    Texts are read and tokenised once: the measures (a few numbers a row) are checkpointed in the shared folder.
    The vocabulary file must be installed where executors run, like the library that reads it.
    """
    bands = BANDS if bands is None else bands
    measured, _ = X.settle(measures(docs, model_path, **options))
    limits = fit_bands(measured, bands)
    names = [c for c in limits.columns if c.startswith(("low_", "high_"))]
    limits, n = X.settle(limits)
    own = X.sized((limits.where("length is not null").drop("documents").withColumnRenamed("kind", "own_kind"), n))
    whole = X.sized((limits.where("length is null").select(F.col("kind").alias("whole_kind"), *[F.col(c).alias(f"whole_{c}") for c in names]), n))
    rows = measured.join(own, (F.col("kind") == F.col("own_kind")) & (_length_class(F.col("n_words")) == F.col("length")), "left").join(whole, F.col("kind") == F.col("whole_kind"), "left")
    bound = lambda c: F.when(F.col("own_kind").isNotNull(), F.col(c)).otherwise(F.col(f"whole_{c}"))
    why = F.when(F.col("base_failed"), "base")
    for m in ("chars_per_token", "tokens_per_word", "byte_share", "token_entropy"):
        for side in ("low", "high"):
            if f"{side}_{m}" in names:
                limit = bound(f"{side}_{m}")
                why = why.when((F.col(m) < limit) if side == "low" else (F.col(m) > limit), m)
    return rows.select(*measured.columns, why.alias("rejected_by"), why.isNull().alias("kept"))


def default_model() -> str:
    """The public 32,000-piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
