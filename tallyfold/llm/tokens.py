"""Token ids of a public byte-level BPE vocabulary.

The vocabulary is given by the path of its `tokenizers` JSON file. Ids are
those of that file; they are computed from its merges and its byte alphabet
by `tiktoken`, which gives the same ids several times faster. The tests
hold both against each other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import tiktoken

# Fixed value: the cutting pattern of this family of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the characters that `\s` stands for in that pattern, in runs of 10,000 and more.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_alphabet() -> dict[str, int]:
    """Byte-level files write each byte as one printable character: printable
    Latin-1 stands for itself, the other bytes for 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def load_encoder(path: str):
    """text -> array of ids, as `tokenizers` gives them at its defaults: the
    strings of the file's added tokens stand for those tokens. The function's
    `sizes` are the bytes that each id stands for.

    The cutting pattern looks ahead after white space, step by step, which
    overflows the stack on a run of about a million. So such a run is dealt
    with apart: all of it but the last character is one piece (all of it at
    the end of a section), which is what the pattern makes of it."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in added}
    name = Path(path).stem
    pieces = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tiktoken.Encoding(name + "-whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def section(text: str) -> list[np.ndarray]:
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += [pieces.encode_to_numpy(text[at:run.start()]), whole.encode_to_numpy(text[run.start():end])]
            at = end
        return [*out, pieces.encode_to_numpy(text[at:])]

    def encode(text: str) -> np.ndarray:
        if marks is None or not any(mark in text for mark in added):
            parts = section(text)
        else:
            parts = [a for k, part in enumerate(marks.split(text))
                     for a in ([np.array([added[part]], np.uint32)] if k % 2 else section(part))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    encode.sizes = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)  # bytes of each id
    for token, i in [*ranks.items(), *((t.encode("utf-8"), i) for t, i in added.items())]:
        encode.sizes[i] = len(token)
    return encode
