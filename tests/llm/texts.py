"""Plain forms of what the operators compute, and test rows."""

import re

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    """The words of a text, told plainly."""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LETTERS)) if w]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def roots(ends, links):
    """The smallest member of each one's connected group."""
    parent = {x: x for x in ends}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in ends}


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 4))) + draw.choice(["", "", ",", "é"]) for _ in range(n))


AWKWARD = "doc_id long, text string, id int, h string, row string, score double, source string"
