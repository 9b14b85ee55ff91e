"""A small table of documents with the awkward cases: nulls, blanks, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rnd, n, stock=400):
    return " ".join(f"w{rnd.randrange(stock)}" for _ in range(n))


def documents(seed=3):
    rnd = random.Random(seed)
    rows = []

    def add(text, lang="en", source=None):
        rows.append((len(rows) * 3 + 1, text, lang, source or f"s{rnd.randrange(12)}", len(text or "")))

    add(None), add(""), add(" \t\n\x0b"), add("one two"), add("One TWO"), add("one two three four five"), add("日本語のテキスト" * 30, "ja")
    base = words(rnd, 300)
    for k in range(12):  # near copies, in a chain and around a base
        w = base.split()
        for _ in range(k * 3):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(999)}"
        add(" ".join(w))
    for _ in range(6):
        add(base)  # exact copies
    add(base.upper())
    for _ in range(25):
        add("\n".join(words(rnd, rnd.randrange(3, 30)) for _ in range(rnd.randrange(1, 6))))
    for k in range(14):  # one line on many sites
        add(f"{words(rnd, 12)}\nThe same footer on every site .\n\n{words(rnd, 9)}", source=f"s{k}")
    for k in range(6):  # one line on few sites
        add(f"only a few sites have this line\n{words(rnd, 15)}", source=f"s{k}")
    add("a b c " * 40), add("mail bob@example.com call +1 (319) 555-5132 from 10.0.0.1, card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32"), add("x" * 9000)
    rows.append((None, "a row without an id but with words in it", "en", None, 40))
    return rows
