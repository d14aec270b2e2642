"""Tables read from a byte-level BPE vocabulary file, and the pieces that its pre-tokenizer makes."""

from __future__ import annotations

import json
import re

import regex

#: Fixed value: the published byte-level pre-tokenization pattern; white space is the Unicode property.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PIECES = regex.compile(PIECE_PATTERN)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    out.update({chr(256 + k): b for k, b in enumerate(rest)})
    return out


def read_vocabulary(path: str) -> tuple[list[bytes], dict[tuple[int, int], int], dict[str, int]]:
    """Token bytes by id, merged id by pair of ids, and special strings by content.

    Raises ValueError unless ids of merged tokens rise with their merge's rank, which the encoder relies on.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for text, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in text)
    for text, i in special.items():
        tokens[i] = text.encode()
    pairs, last = {}, -1
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        made = vocab[a + b]
        if made <= last:
            raise ValueError("merged ids must rise with the merges' ranks")
        pairs[vocab[a], vocab[b]] = last = made
    return tokens, pairs, special


def special_pattern(special: dict[str, int]) -> regex.Pattern | None:
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None


#: White space other than a blank and a line feed.
_RARE_SPACE = re.compile("[\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def units(text: str) -> tuple[str, list[str]] | None:
    """The text cut before each white space: the first unit as it is, the others without a leading blank.

    No pre-token goes over the start of a run of white space, so units can be encoded one by one and looked up in a
    cache. A unit that starts with a line feed stands for itself, another one for a blank and itself. None where white
    space comes in runs or in other characters; such texts are cut by the pattern itself.
    """
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or _RARE_SPACE.search(text):
        return None
    found = text.replace("\n", " \n").split(" ")
    return found[0], found[1:]


def spelled(unit: str) -> str:
    return unit if unit[:1] == "\n" else " " + unit
