"""Token counts: BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import kept, map_texts, table

NONE = np.int64(1) << 62
#: Distinct words whose counts a worker keeps; beyond it the memory is emptied and filled anew.
KEPT_WORDS = 400_000
SPACE = "▁"


def load_pieces(model_path: str) -> dict:
    """The merge table of a sentencepiece BPE model: for each pair of symbols, the rank and symbol of the piece they make.

    Its size is that of the vocabulary, whatever the corpus.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    usable.sort(key=lambda i: (-sp.get_score(i), i))
    pieces = [sp.id_to_piece(i) for i in usable]
    if any(not re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in pieces):
        raise ValueError("pieces of this model cross word boundaries")
    symbols = {p: k for k, p in enumerate(pieces)}
    for c in sorted({c for p in pieces for c in p} - symbols.keys()):
        symbols[c] = len(symbols)
    pairs = {}
    for rank, p in enumerate(pieces):
        for k in range(1, len(p)):
            a, b = symbols.get(p[:k]), symbols.get(p[k:])
            if a is not None and b is not None:
                pairs[a * len(symbols) + b] = rank
    keys = np.array(sorted(pairs), np.int64)
    chars = sorted(c for c in symbols if len(c) == 1)
    return {
        "size": len(symbols),
        "keys": keys,
        "ranks": np.array([pairs[k] for k in keys.tolist()], np.int64),
        "chars": np.array([ord(c) for c in chars], np.int64),
        "char_symbols": np.array([symbols[c] for c in chars], np.int64),
        "pieces": len(pieces),
        "apart": "".join(c for c in "\n\r\t" if c not in symbols),
    }


def _ranks(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair of symbols, NONE where they make no piece. A piece's rank is also its symbol."""
    key = a * t["size"] + b
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    return np.where((a >= 0) & (b >= 0) & (t["keys"][at] == key), t["ranks"][at], NONE)


def merge_counts(words: list[str], t: dict) -> np.ndarray:
    """Symbols that survive in each word.

    All words lie one after another in flat arrays. Each round takes the lowest rank of every word that still has a
    mergeable pair and applies it in all of these words at once. Within a word the library merges one pair at a time,
    leftmost first; all places of the pair are taken in one round only if no pair that arises between would come first.
    A character outside the vocabulary counts as its UTF-8 bytes.
    """
    out = np.zeros(len(words), np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    if not len(code):
        return out
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.minimum(np.searchsorted(t["chars"], code), len(t["chars"]) - 1)
    sym = np.where(t["chars"][at] == code, t["char_symbols"][at], -1)
    cost = np.where((sym >= 0) & (sym < t["pieces"]), 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
    rank = np.full(len(sym), NONE)
    rank[:-1] = np.where(owner[:-1] == owner[1:], _ranks(t, sym[:-1], sym[1:]), NONE)
    while len(sym):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
        if (over := low == NONE).any():
            np.add.at(out, owner[over], cost[over])
            sym, cost, rank, owner, low = (x[~over] for x in (sym, cost, rank, owner, low))
            if not len(sym):
                break
        pick = np.flatnonzero(rank == low)
        run = np.r_[True, np.diff(pick) > 1]  # "aaa": in a run of touching places every second one is taken
        pick = pick[(np.arange(len(pick)) - np.maximum.accumulate(np.where(run, np.arange(len(pick)), 0))) % 2 == 0]
        lead = np.r_[True, owner[pick][1:] != owner[pick][:-1]]
        if not lead.all():
            taken = np.zeros(len(sym) + 3, bool)
            taken[pick] = True
            pad = np.r_[sym, -1, -1, -1]
            same = np.r_[owner, -1, -1, -1]
            made, whose = low[pick], owner[pick]
            right = np.where(same[pick + 2] == whose, pad[pick + 2], -1)
            left = np.where(taken[pick - 2] & (pick >= 2), made, np.where(same[pick - 1] == whose, pad[pick - 1], -1))
            bad = np.minimum(_ranks(t, made, right), _ranks(t, left, made)) <= made
            unsafe = np.zeros(len(words), bool)
            unsafe[whose[bad]] = True
            pick = pick[lead | ~unsafe[whose]]
        sym[pick] = low[pick]
        cost[pick] = 1
        keep = np.ones(len(sym), bool)
        keep[pick + 1] = False
        at = (np.cumsum(keep) - 1)[pick]
        sym, cost, rank, owner = (x[keep] for x in (sym, cost, rank, owner))
        for k in (at, at[at > 0] - 1):
            nxt = np.minimum(k + 1, len(sym) - 1)
            rank[k] = np.where((k + 1 < len(sym)) & (owner[nxt] == owner[k]), _ranks(t, sym[k], sym[nxt]), NONE)
    return out


def count_texts(texts: list[str], t: dict, known: dict[str, int]) -> list[int]:
    """Tokens of each text. Words never merge with one another, so each distinct word is merged once."""
    split = re.compile(f"{SPACE}*[^{SPACE}{t['apart']}]+|{SPACE}+|[{t['apart']}]" if t["apart"] else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
    parts = [split(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
    new = list(set().union(*parts) - known.keys())
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
        new = list(set().union(*parts))
    for a in range(0, len(new), 20_000):
        some = new[a : a + 20_000]
        known.update(zip(some, merge_counts(some, t).tolist()))
    return [sum(map(known.__getitem__, p)) for p in parts]


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Counts the tokens of every text under a sentencepiece BPE model, one row per row of `df`.

    Columns: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null or empty text has 0 bytes and 0
    tokens and is not over the limit; repeated rows give repeated results; a text of any length is counted whole.
    There is no shuffle: texts stay where they were read, and the merge table (bounded by the vocabulary) is broadcast.
    """
    t = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(texts: list[str]) -> list[list]:
        n = count_texts(texts, t.value, kept(model_path))
        return [[len(x.encode()) for x in texts], n, [k > limit for k in n]]

    return map_texts(df, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", run)


def queries() -> dict:
    from public_tokenizers import path

    return {"op1_token_counts": lambda spark, sf_dir: token_counts(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))}
