"""Token counts of a unigram tokenizer by dynamic programming that prefixes share.

The tokenizer: a vocabulary file's pieces, each with a log-probability.  A text
gets a space in front, spaces become the word mark, and every pre-token (a run of
marks and what follows up to the next mark) is cut into the pieces with the
greatest sum of log-probabilities; of equal sums the cut into fewer tokens wins.
A code point that no piece covers costs ``UNKNOWN`` and counts as its UTF-8
bytes (byte fallback).  Pieces never have a mark after another character, so
cutting pre-tokens one by one is cutting the whole text.

The file gives merge ranks, so a piece's log-probability follows from its rank
by Zipf's law, ``-log(rank + 1)``, in whole millionths: sums are exact and ties
are real ties.

Distinct pre-tokens go into a trie.  A node stands for a prefix and holds the
best score and count of that prefix, computed once however many pre-tokens share
it; a terminal node holds the pre-token's count, from where it is taken whenever
the pre-token comes again.  The trie is emptied when it reaches a bound, and
pre-tokens longer than ``DEEP`` run by themselves with a
window of the longest piece, so memory is bounded for any text.

Defined cases: null and empty texts have no tokens; repeated rows give repeated
rows; a null id stays null; an empty table gives an empty one; other columns are
left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import _shared

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Millionths; far below any sum of pieces that could replace it.
UNKNOWN = -40_000_000
DEEP, NODES, KNOWN = 128, 1_000_000, 600_000


def load_pieces(path: str) -> dict[str, int]:
    """Score by piece, for the ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(ordinary, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -round(1e6 * math.log(rank + 1)) for rank, i in enumerate(ranked, start=1)}


class Trie:
    """Nodes are numbers; an edge's key is the node's number and the code point together."""

    def __init__(self, pieces: dict[str, int], nodes: int = NODES):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.suffixes = {p[i:]: 0 for p in pieces for i in range(len(p))} | pieces  # no piece's score is 0
        self.bound = nodes
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.score, self.tokens, self.terminal = [0], [0], [0]
        self.ends: dict[str, int] = {}  # the terminal nodes of pre-tokens

    def count(self, token: str) -> int:
        """Tokens of one pre-token, from its terminal node."""
        if len(token) > DEEP:
            return self._alone(token)
        node = self.ends.get(token)
        if node is None:
            node = self.insert(token)  # may empty the trie first
        return self.terminal[node]

    def insert(self, token: str) -> int:
        """The terminal node of a pre-token; prefixes that are there keep their scores."""
        if len(self.score) > self.bound or len(self.ends) >= KNOWN:
            self.clear()
        edges, score, tokens = self.edges, self.score, self.tokens
        node, path, end = 0, [0], 0
        for c in token:  # the shared prefix: its scores are there
            nxt = edges.get(node << 21 | ord(c))
            if nxt is None:
                break
            node = nxt
            path.append(node)
            end += 1
        get = self.suffixes.get
        for end in range(end + 1, len(token) + 1):
            start = end - 1
            piece, at = get(token[start]), path[start]
            if piece:
                best, fewest = score[at] + piece, tokens[at] + 1
            else:
                best, fewest = score[at] + UNKNOWN, tokens[at] + len(token[start].encode("utf-8", "replace"))
            while piece is not None and start:  # no longer piece ends here once none has this suffix
                start -= 1
                piece = get(token[start:end])
                if piece:
                    at = path[start]
                    s, n = score[at] + piece, tokens[at] + 1
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
            edges[node << 21 | ord(token[end - 1])] = node = len(score)
            path.append(node)
            score.append(best)
            tokens.append(fewest)
            self.terminal.append(-1)
        self.terminal[node] = tokens[node]
        self.ends[token] = node
        return node

    def _alone(self, token: str) -> int:
        """The same recursion for a long pre-token, keeping as many states as the longest piece needs."""
        get, m = self.pieces.get, self.longest + 1
        window = [(0, 0)] * m
        for end in range(1, len(token) + 1):
            best, fewest = None, 0
            for start in range(max(0, end - self.longest), end):
                piece, more = get(token[start:end]), 1
                if piece is None:
                    if start < end - 1:
                        continue
                    piece, more = UNKNOWN, len(token[start].encode("utf-8", "replace"))
                s, n = window[start % m]
                s, n = s + piece, n + more
                if best is None or s > best or s == best and n < fewest:
                    best, fewest = s, n
            window[end % m] = (best, fewest)
        return window[len(token) % m][1]


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_pretokens, n_chars (code points)."""

    def run(batches):
        trie = Trie(load_pieces(path))
        for b in batches:
            tokens, pre, chars = [], [], []
            for text in b.column(1).to_pylist():
                found = Counter(pre_tokens(text))
                nodes = list(map(trie.ends.get, found, repeat(0)))  # the root, which ends nothing, for new pre-tokens
                n = sum(map(mul, map(trie.terminal.__getitem__, nodes), found.values()))
                if 0 in nodes:
                    n += sum(trie.count(token) * times for (token, times), node in zip(found.items(), nodes, strict=True) if not node)
                tokens.append(n)
                pre.append(sum(found.values()))
                chars.append(len(text or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (tokens, pre, chars))], [id_column, "n_tokens", "n_pretokens", "n_chars"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(_shared.released(run), f"{id_column} {kind}, n_tokens long, n_pretokens long, n_chars long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_shared.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
