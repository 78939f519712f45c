"""Token counts of whole texts by a tokenizer file, huge documents by overlapping chunks.

A document of more than `chunk_chars` characters is encoded in chunks that overlap. Tokens before and after a place
do not depend on each other where a pre-token begins: the splitting pattern looks back at nothing and ahead at a few
characters only, and merges stay inside a pre-token. So a place where both chunks begin a pre-token, far enough from
the left chunk's end, is proven stable, and the counts are spliced there. Where the overlap has no such place (one
pre-token fills it), it is widened and the right chunk is encoded again; at worst it takes in all of the left one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import small_batches, text_of

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
LIMIT = 1024
#: The splitting pattern looks ahead at one character more than its match, a contraction has three.
LOOK_AHEAD = 4
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    longest = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    return tokenizer, LOOK_AHEAD + longest


def pre_token_starts(encoding, base: int, low: int, high: int) -> dict[int, int]:
    """Places low < p <= high (in the document) where a pre-token begins, and the number of tokens before each."""
    words, found = encoding.word_ids, {}
    for i, (start, _) in enumerate(encoding.offsets):
        p = base + start
        if p > high:
            break
        if i and p > low and (words[i] is None or words[i] != words[i - 1]):
            found[p] = i
    return found


def spliced_count(encode, text: str, margin: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of text. encode gives an encoding with word_ids and offsets; margin: characters it may look ahead."""
    base, end = 0, min(chunk, len(text))
    left, total, before, joined = encode(text[:end]), 0, 0, 0  # before: tokens of `left` already counted; joined: where the last splice was
    while end < len(text):
        wide = min(overlap, end - joined)
        while True:
            start, stop = end - wide, min(end - wide + chunk, len(text))
            stop = max(stop, min(end + chunk // 2, len(text)))
            right = encode(text[start:stop])
            ours = pre_token_starts(left, base, joined, end - margin)
            theirs = pre_token_starts(right, start, start, end - margin)
            if common := ours.keys() & theirs.keys():
                joined = max(common)
                total += ours[joined] - before
                base, end, left, before = start, stop, right, theirs[joined]
                break
            if start <= joined:  # nothing stable since the last splice: the right chunk begins there and replaces the left one
                base, end, left, before = start, stop, right, 0
                break
            wide = min(2 * wide, end - joined)
    return total + len(left.ids) - before


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and tokens. No tokens are added at either end; special strings inside texts are
    handled as the library does by default. Other columns are not read; repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, margin = _tokenizer(tokenizer_path)
        whole = lambda text: tokenizer.encode(text, add_special_tokens=False)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            for at in range(0, len(short), 32):
                some = short[at : at + 32]
                for i, encoding in zip(some, tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                    counts[i] = len(encoding)
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    counts[i] = spliced_count(whole, t, margin, chunk_chars, overlap_chars)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(batch.column("text")), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)
