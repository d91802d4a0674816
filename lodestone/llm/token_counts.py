"""Token counts without tokens: a unigram tokenizer's best segmentation, of which only the score and the piece count are carried.

An Aho-Corasick automaton over the vocabulary lists every match of a pre-token by its end, longest first; dynamic programming
keeps for each position the best score and the count of pieces on its path. Ties are the tokenizer's: a later candidate for a
position must be strictly better, and candidates come by ascending start, so the longer last piece stays. A character that no
piece of one character covers may be an unknown, at the lowest score less ten; unknowns count their UTF-8 bytes (byte fallback)
or, without it, one for each run. Spaces start pre-tokens and are written as U+2581; one is set before the text.

Pre-tokens repeat, so each worker remembers the counts of those it has met, in a table of bounded size.
Scores: the vocabulary file gives ranks; a piece of rank r has the log probability of a Zipf law, -ln(r + 1) - ln(H).

Defined cases: a null or empty text has 0 tokens; rows with the same id count each for themselves.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import common as C

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens that a worker remembers.
REMEMBERED = 400_000


def ranked_pieces(model_file: str) -> list[tuple[str, float]]:
    """(piece, log probability) of the file's ordinary pieces, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    own.sort(key=lambda i: (-sp.get_score(i), i))
    norm = math.log(sum(1 / (r + 1) for r in range(len(own))))
    return [(sp.id_to_piece(i), -math.log(r + 1) - norm) for r, i in enumerate(own)]


class Counter:
    """Counts of pieces, remembered by pre-token (with its U+2581)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.known = C.Recent(lambda word: self.segment(word)[1], REMEMBERED)
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.match = ahocorasick.Automaton()
        for piece, score in pieces:
            self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()

    def segment(self, word: str) -> tuple[float, int]:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.match):
            for end, found in self.match.iter(word):
                ends[end + 1].append(found)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, at, single, lone = -math.inf, -1, False, False
            for length, score in ends[e]:
                single = single or length == 1
                if (s := best[e - length] + score) > top:
                    top, at = s, e - length
            if not single and (s := best[e - 1] + self.unknown) > top:
                top, at, lone = s, e - 1, True
            best[e], unknown[e] = top, lone
            if not lone:
                count[e] = count[at] + 1
            elif self.byte_fallback:
                count[e] = count[at] + len(word[at].encode("utf-8", "surrogatepass"))
            else:
                count[e] = count[at] + (not unknown[at])
        return best[n], count[n]

    def of(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0]:
            del parts[0]
        return sum(map(self.known.__getitem__, [SPACE + p for p in parts]))


@lru_cache(maxsize=4)
def counter(model_file: str, byte_fallback: bool = True) -> Counter:
    return Counter(ranked_pieces(model_file), byte_fallback)


def token_counts(docs: DataFrame, model_file: str, byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of every document; ``model_file`` is read on each worker."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model_file, byte_fallback)
        n = np.fromiter((count.of(t.as_py() or "") for t in batch.column(1)), np.int64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return C.map_text(docs, step, "doc_id long, n_tokens long")
