"""Token counts of a unigram vocabulary, by dynamic programming shared in a trie.

Each task inserts the distinct pre-tokens of its documents in a trie. A node stands for a prefix and stores the
forward score of the best segmentation of that prefix and its number of pieces; it is scored once, when it is
made, from the scores of its ancestors. A pre-token's count is read at its terminal node, so a prefix that a
thousand words share is scored once. The trie is dropped when it reaches MAX_NODES or remembers words of MAX_BYTES;
of a pre-token longer than LONG the rest is scored beyond the trie with the last scores only, as many as a piece is
long, and it is not remembered: this bounds a worker's memory and changes no count. There is no shuffle: a document's count is the sum over its pre-tokens.

The vocabulary is a public sentencepiece file. Its pieces stand in order of rank; as unigram score a piece of
rank r has -log(r + 1). A character that no piece covers costs UNKNOWN and counts as one token for each of its
UTF-8 bytes. Ties go to fewer tokens.

Defined cases: null and empty texts count zero; each repeated row is counted; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

UNKNOWN = -25.0
MAX_NODES = 400_000
MAX_BYTES = 32 << 20
LONG = 2_000
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def vocabulary(path: str) -> dict[str, float]:
    """piece: score, for the pieces of a sentencepiece file that are ordinary text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 1) for rank, piece in enumerate(dict.fromkeys(plain), 1)}


class Trie:
    """Prefixes with the forward score and the token count of their best segmentation."""

    def __init__(self, scores: dict[str, float]):
        self.longest = max(map(len, scores), default=1)
        #: What a piece may end with, and its score if it is a piece itself.
        self.tails: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(len(piece))} | scores
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str | bytes, int] = {"": 0}
        self.held = 0

    def remember(self, word: str | bytes, n: int) -> None:
        self.terminal[word] = n
        self.held += len(word)

    def count(self, word: str) -> int:
        """Tokens of `word`; inserts it if it is new."""
        found = self.terminal.get(word)
        if found is not None:
            return found
        if len(self.children) > MAX_NODES or self.held > MAX_BYTES:
            self.clear()
        path = [0]
        for end, char in enumerate(word[:LONG], 1):
            children = self.children[path[-1]]
            node = children.get(char)
            if node is None:
                node = children[char] = len(self.children)
                self.children.append({})
                self._forward(word, end, path, self.score, self.tokens)
            path.append(node)
        if len(word) > LONG:
            return self._beyond(word, path)
        self.remember(word, self.tokens[path[-1]])
        return self.tokens[path[-1]]

    def _forward(self, word: str, end: int, path: Sequence[int], score: list[float], tokens: list[int]) -> None:
        """Score the prefix word[:end] from its ancestors, path[i] being the place of word[:i] in `score` and `tokens`, and append it there."""
        tails = self.tails
        best, fewest = score[path[end - 1]] + UNKNOWN, tokens[path[end - 1]] + len(word[end - 1].encode("utf-8", "surrogatepass"))
        for start in range(end - 1, -1, -1):
            piece = tails.get(word[start:end], False)
            if piece is False:  # no piece ends like this
                break
            if piece is not None:
                at = path[start]
                value, n = score[at] + piece, tokens[at] + 1
                if value > best or value == best and n < fewest:
                    best, fewest = value, n
        score.append(best)
        tokens.append(fewest)

    def _beyond(self, word: str, path: list[int]) -> int:
        """Tokens of a word whose first LONG characters are the nodes of `path`; of the rest, the last scores alone are kept."""
        score, tokens = [self.score[i] for i in path[-self.longest :]], [self.tokens[i] for i in path[-self.longest :]]
        for at in range(LONG, len(word), LONG):
            before = len(score) - 1
            part = word[at - before : at + LONG]
            for end in range(before + 1, len(part) + 1):
                self._forward(part, end, range(end), score, tokens)
            score, tokens = score[-self.longest :], tokens[-self.longest :]
        return tokens[-1]


@cache
def _trie(path: str) -> Trie:
    return Trie(vocabulary(path))


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document; a pre-token is a word with a leading mark."""
    path = model or default_model()

    def count(texts: list[bytes]) -> dict[str, pa.Array]:
        trie = _trie(path)
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            split = text.split()
            words[i], total, known = len(split), 0, trie.terminal
            for word in split:
                n = known.get(word)
                if n is None:
                    n = trie.count(MARK + word.decode("utf-8", "replace"))
                    known = trie.terminal
                    if len(word) <= LONG:
                        trie.remember(word, n)
                total += n
            tokens[i] = total
        return {"n_pretokens": pa.array(words), "n_tokens": pa.array(tokens)}

    fields = [("n_pretokens", T.LongType()), ("n_tokens", T.LongType())]
    return append_columns(docs.select("doc_id", "text"), "text", fields, count).drop("text")
