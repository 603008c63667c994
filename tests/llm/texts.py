"""Small corpora with what is awkward: copies, near copies, shared passages and lines, odd rows."""

import random


def corpus(n=120, seed=1, vocabulary=400):
    """Rows (doc_id, text)."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(vocabulary)) + rng.choice(["", "", ".", "É", "ß!"])
    passage = [word() for _ in range(90)]
    lines = ["  A line that many documents SHARE ", "a line that many documents share", "Überall dieselbe Zeile hier", "short line"]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            text = rng.choice(texts)
        elif kind < 0.45 and texts:
            w = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.choice([1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            w = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 60, 120, 300]))]
            if rng.random() < 0.5:
                at, a = rng.randrange(len(w) + 1), rng.randrange(45)
                w[at:at] = passage[a : a + rng.choice([48, 49, 50, 51, 70, 90])]
            text = rng.choice([" ", "  ", "\t"]).join(w)
            if rng.random() < 0.6:
                text = "\n".join([text, *rng.sample(lines, 2), " only here " + word() * 6])
        texts.append(text)
    ids = list(range(3, 3 + 2 * n, 2))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t\n "), (1003, "one"), (1004, "One"), (1005, "x " * 3000), (1006, "x " * 2500), (1007, "a b c d e " * 400)]


ODD = [(None, "p q r s t u v w x y " * 9), (5000, "p q r s t u v w x y " * 9), (5000, "p q r s t u v w x y " * 9), (4999, "P q r s t u v w x y " * 9), (None, None)]
