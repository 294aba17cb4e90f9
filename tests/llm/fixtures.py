"""A small table with every awkward case, and what it should give."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, run int, packed string, words string, h1 long, fingerprint string, norm string"
SYLLABLES = ["an", "er", "th", "on", "re", "ti", "ne", "é", "ou", "shi", "ka", "lo"]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts() -> dict[int, str | None]:
    shared, long = prose(1, 60), prose(2, 6_000)
    near = prose(3, 400)
    out = {
        1: None, 2: "", 3: " \n\t ", 4: "one", 5: "one two three", 6: " ".join(shared), 7: " ".join(prose(4, 50) + shared[:30] + prose(5, 20)),
        8: "\n".join([" ".join(prose(6, 20))] * 4), 9: " ".join(long), 10: " ".join(near), 11: " ".join(near), 12: "  ".join(near) + "\n",
        13: " ".join(near[:200] + ["changed"] + near[201:]), 14: "All rights\nreserved. CC-BY cc by 4.0, the GNU General Public License all RIGHTS reserved", 15: "a a a a a a a a a a a a a a a a a a a a",
        16: " ".join(["spam"] * 3000), 17: "Ünïcödé 日本語 x y", 18: "\x00\x1f odd \x85 white space", 19: "<|endoftext|> <|startoftext|>  two   spaces\r\n\x0b\x0c'll don't", 20: " ".join(prose(4, 50)),
        21: " ".join(long[2_000:2_100] + prose(7, 100)), 22: "### $$$ %%% " * 60, 23: "released under the MIT License",
    }
    return out


def rows() -> list[tuple]:
    made = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", None if t is None else len(t), "k", 1, "p", "w", 5, "f", "n") for i, t in texts().items()]
    return [*made, made[9], (None, "no id at all", "en", None, 12, None, None, None, None, None, None, None)]


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
