"""Made-up texts for the tests."""

WORDS = "the of and river stone lamp green quiet moves under seven paper window cold early market"


def sentence(seed: int, n: int) -> str:
    pool = WORDS.split()
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(pool[(x >> 8) % len(pool)] + ("" if x % 3 else str(x % 50)))
    return " ".join(out)


def edited(text: str, at: int) -> str:
    words = text.split(" ")
    words[at] = f"edit{at}"
    return " ".join(words)
