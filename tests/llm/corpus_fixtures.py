import random

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def corpus() -> list[tuple]:
    """Documents with copies, near copies in chains, a shared passage, nulls, blanks, repeated rows and a long text."""
    r = random.Random(3)
    passage = sentence(r, 30)
    texts: list = [None, "", "   ", "one two three", "ONE two\tthree ", "x"]
    for _ in range(12):
        texts.append(sentence(r, r.randrange(5, 60)))
    base = sentence(r, 60).split(" ")
    for _ in range(25):  # near copies, from hardly changed to much changed
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = "edit" + str(r.randrange(1000))
        texts.append(" ".join(words))
    texts += [passage + " " + sentence(r, r.randrange(10, 80)) for _ in range(25)]
    texts += [passage, passage.upper(), passage]
    texts.append(sentence(r, 20_000))
    texts.append("nowhitespaceatall" * 20_000)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src0", "src12", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += rows[6:9] + [(None, texts[7], "en", "src1", 3), (None, None, None, None, None)]
    return rows


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
