"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing further columns."""

import random

#: Names that operators use inside; as further columns they must not matter.
CLASHING = ("gram", "n", "key", "mark", "block", "part", "peek", "component", "doc", "print", "line_no", "near", "ids", "data", "stands", "text_a", "least", "bucket", "lost__", "id__")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, stems: str = "ka lo mi ne ru sa to vi") -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(stems.split()) for _ in range(r.randint(1, 4))) for _ in range(n)]


def prose(seed: int, n: int = 120) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[k : k + 12]) for k in range(0, n, 12))


def edited(text: str, seed: int, changes: int) -> str:
    w, r = text.split(" "), random.Random(seed)
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def rows() -> list[tuple]:
    base = [prose(k) for k in range(12)]
    texts = [*base, base[0], base[0], edited(base[1], 1, 2), edited(base[1], 2, 2), edited(base[2], 3, 40), None, "", " \n\t ", "one two", "ONE Two", "a", "é" * 60 + " " + "ü" * 70, prose(99, 30_000), "Straße Ärger\n" + base[3][:200], "日本語 のテキスト 🎉 " * 8]
    out = [(10 * k + 5, t, "aa" if k % 2 else None, f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[3], (None, base[4], "aa", None, 1), (None, None, None, None, None), (45, prose(77), "bb", "s", 1)]
    return out
