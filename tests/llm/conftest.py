import random

import pytest
from texts import prose


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact copies, near copies, passages that several texts share, junk."""
    draw = random.Random(11)
    passages = [prose(draw, n) for n in (55, 80, 30)]
    texts = []
    for i in range(150):
        kind = i % 6
        if kind == 0 or not texts:
            text = prose(draw, draw.randint(1, 160))
        elif kind == 1:
            text = draw.choice(texts)
        elif kind == 2:
            w = draw.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[draw.randrange(len(w))] = prose(draw, 1)
            text = " ".join(w)
        elif kind == 3:
            text = f"{prose(draw, draw.randint(0, 60))}\n{draw.choice(passages).upper()}\n{prose(draw, draw.randint(0, 60))}".strip()
        elif kind == 4:
            text = "\n".join([draw.choice(passages), prose(draw, 12)] * draw.randint(1, 3))
        else:
            text = " ".join([draw.choice(["a", "b"])] * draw.randint(1, 70))
        texts.append(text)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def awkward():
    """Rows that operators must bear: (doc_id, text, id, h, row, score, source); ids and texts null, empty, white, very long, repeated."""
    draw = random.Random(5)
    long, middle = prose(draw, 60_000), prose(draw, 120)
    texts = [(None, middle), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long + " end"), (6, middle), (7, middle), (7, middle), (8, "x"), (9, "x"), (10, "w" * 300_000), (11, "�\u0000 a\U0001f600b <|im_end|>")]
    return [(i, t, 1, None, "r", 0.5, "s") for i, t in texts]
