"""A small set of tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SYLLABLES = {"en": ["the", "ing", "er", "and", "on", "at", "es", "th", "re"], "fr": ["que", "eau", "ment", "tion", "é", "ai", "oi", "le"], "de": ["sch", "ung", "ein", "keit", "ü", "ge", "ver", "ch"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents():
    rng = random.Random(17)
    rows = []

    def add(text, lang="en"):
        rows.append((len(rows) * 3, text, lang, f"src{len(rows) % 3}"))

    base = [prose(rng, lang, 120) for lang in ("en", "fr", "de", "en", "en", "fr")]
    for i, lang in enumerate(("en", "fr", "de", "en", "en", "fr")):
        add(base[i], lang)
    for i in range(12):  # near copies
        words = base[i % 3].split()
        for _ in range(i % 4 + 1):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(5))
        add(" ".join(words))
    for _ in range(5):  # exact copies, other white space, other case
        add(base[0])
    add(base[1].replace(" ", "  \n"), "fr")
    add(base[2].upper(), "de")
    passage = prose(rng, "en", 70)
    for i in range(8):  # a passage that many share
        add(prose(rng, "en", 30 + 20 * i) + "\n" + passage + " " + prose(rng, "en", 40))
    add(None)
    add(None, None)
    add("")
    add(" \t\n\x0b\x0c\r ")
    add("one two three")
    add("One two THREE")
    add("a b c d e")
    add("$$$ ### " * 60)
    add("same line here\nsame line here\nother " * 20)
    add(prose(rng, "de", 9000), "de")
    add("x" * 5000 + " " + "ab" * 3000)
    add("mail a.b+c@mail.example.com, 1.2.3.4 999.1.1.1, 4111 1111 1111 1111 +1 (555) 555-7713 token = \"9233A8ECF7C5B09F\" iban DE89 3704 0044 0532 0130 00 http://u:p@h/x")
    add("日本語のテキスト です。 ½ Ⅷ İstanbul ΑΣ <|endoftext|> I'm 'S\x1c\x85​z 🙂")
    for lang in ("en", "fr", "de"):
        for _ in range(15):
            add(prose(rng, lang, rng.randint(3, 80)), lang)
    for _ in range(40):
        add(" ".join(w + "###" for w in prose(rng, "en", 60).split()))
    rows.append(rows[3])  # repeated rows
    rows.append(rows[0])
    rows.append((None, base[4], "en", "src0"))
    return rows


ITEMS = [(0, "Which of these are the things that one would never ever find written in any other text at all, said the clerk?"), (1, "short item of just six words"), (2, "two words"), (3, ""), (4, None), (5, "Which of these are the things that one would never ever find written in any other text at all, said the clerk?")]


@pytest.fixture(scope="session")
def rows():
    got = documents()
    rng = random.Random(5)
    for place, extra in enumerate((ITEMS[0][1], ITEMS[0][1].upper().replace(",", " ;"), ITEMS[1][1])):
        got.append((1000 + place, prose(rng, "en", 40) + " " + extra + " " + prose(rng, "en", 30), "en", "src1"))
    return got


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, rows):
    root = tmp_path_factory.mktemp("tables")
    ids, texts, langs, sources = zip(*rows)
    n = len(rows)
    clash = {c: pa.array([7] * n, pa.int64()) for c in ("score", "key", "token", "rep", "n", "first", "hits", "ids", "lang_pred", "c0")}
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()), **clash})
    pq.write_table(docs, root / "documents.parquet")
    known = [i for i in dict.fromkeys(ids) if i is not None]
    bad = {i for i, t in zip(ids, texts) if t is not None and ("###" in t)}
    labels = [(i, 0 if i in bad else 1) for i in known] + [(known[0], 1), (None, 1), (known[1], None)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([q for _, q in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), root / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": pa.array([t for _, t in ITEMS], pa.string())}), root / "benchmark.parquet")
    html = ["<p>a</p>", "<p>b é</p>", "<p>a</p>", None, "", "<p>a</p>", "x" * 200_000, "\r\n\r\nWARC/1.1\r\n\r\n", "<p>b é</p>"]
    pages = pa.table({"page_id": pa.array([9, 4, 3, 8, 7, 5, 1, 2, 6], pa.int64()), "url": pa.array(["http://h/%d\n" % i for i in range(8)] + [None]), "html": pa.array(html, pa.string()), "file": pa.array(["z"] * 9), "refers_to": pa.array([1] * 9, pa.int64())})
    pq.write_table(pages, root / "pages.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, sf_dir):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages"):
        pq.write_table(pq.read_table(f"{sf_dir}/{name}.parquet").slice(0, 0), root / f"{name}.parquet")
    return str(root)
