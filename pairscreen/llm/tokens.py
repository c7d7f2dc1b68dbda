"""Token counts of whole texts, and the encoder that packing shares.

A tokenizer of this family first cuts a text by a pattern in which a lone space
between two characters that are not white space always begins a new part, and no
special token holds a space.  So a text may be cut before any such space and its
parts encoded by themselves: the ids are the same, and texts of any length are
encoded in bounded pieces.
"""

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairscreen.llm.shared import numbered, texts

#: A lone space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The pattern of byte-level pre-tokenizers (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A longer text is encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 20

#: A run of so much white space is found by rule: the pattern would look ahead from
#: each of its characters, and matching engines run out of stack.
RUN_CHARS = 1 << 16
#: Characters that the pattern takes as white space (fixed values).
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)


def long_runs(text, special=()):
    """Parts of a text, and whether each is a long run of white space.  To the pattern
    such a run is one part, but for its last character if a word follows: that one
    goes with what follows.  A special token ends a run as the end of the text does."""
    at = 0
    for found in _RUN.finditer(text) if len(text) >= RUN_CHARS else ():
        start, stop = found.span()
        if stop < len(text) and not text.startswith(tuple(special), stop):
            stop -= 1
        yield text[at:start], False
        yield text[start:stop], True
        at = stop
    yield text[at:], False


def split_long(text, limit=None):
    """Cut at the first safe place after every ``limit`` characters."""
    limit = limit or PIECE_CHARS
    at = 0
    while len(text) - at > limit:
        found = _CUT.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _byte_of_sign():
    """Byte-level vocabularies write printable bytes as themselves and all others
    by the next characters from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return {chr(b if b in own else next(other)): b for b in range(256)}


def _ranks(spec):
    """Ranks of a byte-level BPE whose ids follow its merges, else ``None``."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not (plain and usual) or spec["normalizer"] or spec["post_processor"] or spec["truncation"] or spec["padding"]:
        return None
    vocabulary = model["vocab"]
    merges = (m if isinstance(m, str) else " ".join(m) for m in model["merges"])
    merged = [vocabulary[m.replace(" ", "")] for m in merges]
    special = {t["content"] for t in spec["added_tokens"]}
    if merged != sorted(set(merged)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    byte = _byte_of_sign()
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}


@functools.lru_cache(maxsize=4)
def encoder(path):
    """Function from a text to its ids, kept by the Python worker for the tasks that
    follow.  ``path`` is a JSON file of ``tokenizers``.  A plain byte-level BPE is
    run by ``tiktoken`` from the same vocabulary, which gives the same ids several
    times faster; any other by ``tokenizers`` itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)
    if ranks is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encoding = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    as_one = tiktoken.Encoding(f"{path}-runs", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(text):
        if len(text) < RUN_CHARS:
            return encoding.encode_to_numpy(text, allowed_special="all")
        parts = [
            as_one.encode_to_numpy(part) if run else encoding.encode_to_numpy(part, allowed_special="all")
            for part, run in long_runs(text, special)
        ]
        return np.concatenate(parts)

    return encode


def encode_long(encode, text):
    """Ids of a text of any length."""
    if len(text) <= PIECE_CHARS:
        return encode(text)
    return np.concatenate([encode(piece) for piece in split_long(text)])


def count_tokens(docs, path, id_col="doc_id", text_col="text", limit=1024, batch_bytes=4 << 20):
    """Token counts of whole texts: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``
    and ``over_limit`` (more tokens than ``limit``).

    ``path`` is a ``tokenizers`` JSON file that every executor can read.  Strings
    of special tokens inside a text count as the tokenizer takes them by default.
    Rows come in Arrow batches, which are encoded in runs of about ``batch_bytes``;
    nothing but lengths leaves the task, and there is no shuffle.

    A null text is empty: 0 bytes, 0 tokens.  A null id stays null.  Repeated rows
    are counted one by one, an empty table gives none, other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        encode = encoder(path)
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column("text")), 0).cast(pa.int64())
            bounds = np.cumsum(size.to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                done = bounds[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(bounds, done + batch_bytes, side="right")))
                batch = whole.slice(at, stop - at)
                n = [sum(len(encode(piece)) for piece in split_long(t)) for t in texts(batch)]
                tokens = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), size.slice(at, stop - at), tokens, pc.greater(tokens, limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )
                at = stop

    schema = numbered([("id", kind), ("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")])
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)
