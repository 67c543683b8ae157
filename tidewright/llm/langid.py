"""Language ID: a linear-chain conditional random field that labels words in code-switched text."""

from __future__ import annotations

import re
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, kept, table

BUCKETS = 1 << 15
CHAIN = 64
#: Bounds of what the model is fitted on: documents, characters of one, and distinct words in the lexicon.
TRAIN_DOCS, TRAIN_CHARS, LEXICON = 1200, 20_000, 20_000
KEPT_WORDS = 200_000
UNKNOWN = "und"
find_words = re.compile(r"[^\W\d_]+").findall


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in one array, and whose they are: prefixes and suffixes of 1 to 3 letters, 1- to 3-grams, and the word if the lexicon has it."""
    n = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), n)
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    left = n[owner] - at
    found, whose = [], []
    gram = np.zeros(len(code), np.uint64)
    for k in (1, 2, 3):
        shifted = np.zeros(len(code), np.uint64)
        shifted[: len(code) - k + 1] = code[k - 1 :]
        gram = (gram + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for kind, where in ((1, left >= k), (2, (left >= k) & (at == 0)), (3, left == k)):
            h = (gram[where] ^ np.uint64(kind * 0xD6E8FEB8)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            found.append((h >> np.uint64(49)).astype(np.int64))
            whose.append(owner[where])
    known = [(lexicon[w] + BUCKETS, k) for k, w in enumerate(words) if w in lexicon]
    if known:
        found.append(np.array([x for x, _ in known], np.int64))
        whose.append(np.array([k for _, k in known], np.int64))
    return np.concatenate(found), np.concatenate(whose)


def emissions(words: list[str], model: dict) -> np.ndarray:
    """Scores of each label for each word: the mean weight of its features."""
    f, whose = word_features(words, model["lexicon"])
    weights = model["weights"]
    count = np.maximum(1, np.bincount(whose, minlength=len(words)))
    return np.stack([np.bincount(whose, weights[f, k], len(words)) for k in range(weights.shape[1])], 1) / np.sqrt(count)[:, None]


def forward_backward(score: np.ndarray, mask: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Marginals of each word's label over chains laid in rows, and the expected moves if asked for.

    score: (chains, words, labels); mask: whether a place holds a word (they stand to the left).
    """
    n, steps, labels = score.shape
    local = np.exp(score - score.max(2, keepdims=True))
    step = np.exp(move)
    ahead, behind = np.empty_like(local), np.ones_like(local)
    a = np.full((n, labels), 1.0 / labels)
    for t in range(steps):
        a = (a @ step if t else a) * local[:, t]
        a /= a.sum(1, keepdims=True)
        ahead[:, t] = a
    for t in range(steps - 2, -1, -1):
        b = (behind[:, t + 1] * local[:, t + 1]) @ step.T
        b /= b.sum(1, keepdims=True)
        behind[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
    out = ahead * behind
    out /= out.sum(2, keepdims=True)
    if not pairs:
        return out
    joint = ahead[:, :-1, :, None] * step * (local * behind)[:, 1:, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return out, (joint * mask[:, 1:, None, None]).sum((0, 1))


def lay_out(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts sequences into chains of at most `width`; gives the padded chains, their mask, and whose each chain is."""
    pieces = [(r[a : a + width], k) for k, r in enumerate(rows) for a in range(0, len(r), width)]
    chain = np.zeros((len(pieces), width), np.int64)
    length = np.array([len(p) for p, _ in pieces], np.int64)
    mask = np.arange(width) < length[:, None]
    if pieces:
        chain[mask] = np.concatenate([p for p, _ in pieces])
    return chain, mask, np.array([k for _, k in pieces], np.int64)


def fit(texts: list[str], langs: list[str], epochs: int = 6, seed: int = 7) -> dict:
    """Fits the field on a bounded sample of labelled texts by adaptive gradient steps on the likelihood of the chains."""
    labels = sorted(set(langs))
    rows = [[w for w in find_words(x.lower())] for x in texts]
    often: dict[str, int] = {}
    for r in rows:
        for w in r:
            often[w] = often.get(w, 0) + 1
    top = sorted((w for w, n in often.items() if n > 1), key=lambda w: (-often[w], w))[:LEXICON]
    lexicon = {w: k for k, w in enumerate(top)}
    vocab = {w: k for k, w in enumerate(sorted(often))}
    f, whose = word_features(list(vocab), lexicon)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(whose, minlength=len(vocab))))
    order = np.argsort(whose, kind="stable")
    f, start = f[order], np.r_[0, np.cumsum(np.bincount(whose, minlength=len(vocab)))]
    chain, mask, who = lay_out([np.array([vocab[w] for w in r], np.int64) for r in rows], 32)
    gold = np.array([labels.index(x) for x in langs], np.int64)[who]
    weights = np.zeros((BUCKETS + len(lexicon), len(labels)))
    move = np.zeros((len(labels), len(labels)))
    seen_w, seen_m = np.full(weights.shape, 1e-6), np.full(move.shape, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        mix = rng.permutation(len(chain))
        for a in range(0, len(mix), 256):
            some = mix[a : a + 256]
            m, words = mask[some], np.unique(chain[some][mask[some]])
            if not len(words):
                continue
            size = start[words + 1] - start[words]
            mine = np.repeat(np.arange(len(words)), size)
            feats = f[np.repeat(start[words] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            score = np.stack([np.bincount(mine, weights[feats, k], len(words)) for k in range(len(labels))], 1) * scale[words][:, None]
            local = np.searchsorted(words, np.where(m, chain[some], words[0]))
            given, moves = forward_backward(score[local], m, move, True)
            want = np.eye(len(labels))[gold[some]]
            error = ((want[:, None, :] - given) * m[:, :, None]).reshape(-1, len(labels))
            per_word = np.stack([np.bincount(local.reshape(-1), error[:, k], len(words)) for k in range(len(labels))], 1) * scale[words][:, None]
            grad = np.stack([np.bincount(feats, per_word[mine, k], len(weights)) for k in range(len(labels))], 1) - 1e-3 * weights
            seen_w += grad**2
            weights += 0.2 * grad / np.sqrt(seen_w)
            grad = np.diag((want.T @ m[:, 1:].sum(1)[:, None])[:, 0]) - moves - 1e-3 * move
            seen_m += grad**2
            move += 0.05 * grad / np.sqrt(seen_m)
    return {"labels": labels, "weights": weights, "move": move, "lexicon": lexicon}


def label_texts(texts: list[str], model: dict, known: dict) -> tuple[list[str], list[float], list[float]]:
    """Language of each text, its score (the mean marginal of that label over the words), and how sure the words are (the mean of each one's largest marginal)."""
    rows = [find_words(x.lower()) for x in texts]
    index, table_ = known.setdefault("index", {}), known.get("table")
    new = list(set().union(*rows) - index.keys())
    if table_ is None or len(index) + len(new) > KEPT_WORDS:
        index.clear()
        table_, new = np.zeros((0, len(model["labels"]))), list(set().union(*rows))
    if new:
        score = emissions(new, model)
        score[[not any(map(str.isalpha, w)) for w in new]] = np.nan
        index.update(zip(new, range(len(table_), len(table_) + len(new))))
        table_ = np.concatenate([table_, score])
    known["table"] = table_
    ids = [np.fromiter(map(index.__getitem__, r), np.int64, len(r)) for r in rows]
    ids = [x[~np.isnan(table_[x, 0])] for x in ids]
    chain, mask, who = lay_out(ids, CHAIN)
    total, sure = np.zeros((len(texts), len(model["labels"]))), np.zeros(len(texts))
    for a in range(0, len(chain), 4096):
        m = mask[a : a + 4096]
        given = forward_backward(table_[chain[a : a + 4096]], m, model["move"])
        np.add.at(total, who[a : a + 4096], (given * m[:, :, None]).sum(1))
        np.add.at(sure, who[a : a + 4096], (given.max(2) * m).sum(1))
    n = total.sum(1)
    share = total / np.maximum(n, 1e-9)[:, None]
    best = share.argmax(1)
    lang = [model["labels"][k] if c > 0 else UNKNOWN for k, c in zip(best.tolist(), n.tolist())]
    score = [min(1.0, round(float(s[k]), 6)) if c > 0 else 0.0 for s, k, c in zip(share, best, n.tolist())]
    return lang, score, np.minimum(1.0, np.round(sure / np.maximum(n, 1e-9), 6)).tolist()


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """At most TRAIN_DOCS labelled rows of at most TRAIN_CHARS characters, those of the lowest hash of the id among all but each fifth."""
    rows = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.length(text_col).between(1, TRAIN_CHARS)).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    last = rows.select("h").orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    return [] if last is None else rows.filter(F.col("h") <= last).orderBy("h", "t", "l").limit(2 * TRAIN_DOCS).collect()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model; None if no row has a language to learn from."""
    rows = sorted(training_rows(df, id_col, text_col, lang_col), key=lambda r: (r["h"], r["t"]))
    return fit([r["t"] for r in rows], [r["l"] for r in rows]) if rows else None


def language(df: DataFrame, model: dict | None, text_col: str = "text") -> Column:
    """A column of lang_pred, score (mean marginal of that language over the words) and sure (mean of each word's largest marginal) for every text of `df`.

    Texts without a letter, null and empty ones get `und` with score 0, as all do without a model. Words are all letter
    runs of the whole text, in chains of CHAIN words. No shuffle; the model (bounded by its parameters) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = uuid4().hex

    def run(column: pa.Array) -> pa.Array:
        texts = [x or "" for x in column.to_pylist()]
        lang, score, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if shared.value is not None:
            for a, b in groups(texts):
                lang[a:b], score[a:b], sure[a:b] = label_texts(texts[a:b], shared.value, kept(key))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], ["lang_pred", "score", "sure"])

    return F.arrow_udf(run, "lang_pred string, score double, sure double")(F.col(text_col))


def predict(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every text: the id, lang_pred, score; one row per row of `df`. Repeated rows give repeated results, an empty table none."""
    return df.select(F.col(id_col), language(df, model, text_col).alias("language_")).select(id_col, "language_.lang_pred", "language_.score")


def _op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id").alias("held_out")
    return predict(docs, train(docs)).select("doc_id", held, "lang_pred", "score")


def queries() -> dict:
    return {"op9_language_id": _op9}
