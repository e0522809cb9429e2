"""Exact text encoding by a public tokenizer file, with each distinct word encoded once.

The tokenizer's normaliser and pre-tokenizer never join characters across white space,
so a text's ids are the ids of its blank-separated words in order. A task remembers
words and letter runs; new runs of plain Latin words go straight to the library's BPE
model, any other new word goes through the whole library pipeline.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from rankframe.llm.common import SLICE_BYTES, Memo, parts

#: Words and letter runs remembered by a task; a memo is emptied beyond that, which
#: changes no result.
MEMO_WORDS, MEMO_RUNS = 200_000, 200_000

#: Words for which the pipeline is known: printable ASCII and precomposed Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the tokenizer file's splitting pattern, over those characters.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.words = Memo(self._word, MEMO_WORDS)
        self.runs: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [s.get("type") for s in (parts.get("normalizer") or {}).get("normalizers", [])]
        splits = [s["pattern"]["Regex"] for s in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split"]
        # the short way holds for this pipeline only; other files use the library throughout
        self.short = steps == ["NFC", "Replace", "Lowercase"] and splits == [_SPLIT] and parts.get("post_processor") is None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parts.get("added_tokens", [])) or "(?!)")
        self.packed = [np.array(i, self.dtype).tobytes() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _run(self, run: str) -> bytes:
        if len(self.runs) > MEMO_RUNS:
            self.runs.clear()
        packed, mapped = self.packed, run if run.isascii() else run.translate(self.bytewise)
        self.runs[run] = out = b"".join([packed[t.id] for t in self.tokenizer.model.tokenize(mapped)])
        return out

    def _word(self, word: bytes) -> bytes:
        runs = self.runs
        if self.short and word.isalpha():  # ASCII letters only
            run = word.decode().lower()
            return runs.get(run) or self._run(run)
        text = word.decode("utf-8", "replace")
        if self.short and _PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join([runs.get(r) or self._run(r) for r in _SPLIT_PLAIN.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Packed ids of one text. Words are told apart by their bytes."""
        if len(text) <= SLICE_BYTES:
            return b"".join(map(self.words.__getitem__, text.split()))
        return b"".join([b"".join(map(self.words.__getitem__, part.split())) for part in parts(text)])

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice (see ``common.as_bytes``) in one array, each row with
        the end id after it, and the n+1 places in it where rows begin."""
        raw, at, end = data.tobytes(), offsets.tolist(), self.packed[end_id]
        rows = [self.encode(raw[a:b]) + end for a, b in zip(at, at[1:])]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // self.width
        return np.frombuffer(b"".join(rows), self.dtype), np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file; Spark reuses worker processes."""
    return Codec(path)
