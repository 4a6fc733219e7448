"""The whole pipeline against plain Python: each stage's decision worked out by force, the last stage by the library."""

import hashlib
import random

from ragloom.llm.queries import tokenizer_path
from tests.llm.test_llm import components_by_force, overlaps_by_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"xx": "alba doro minu tesa vora lume nido casa fino gelo".split(), "yy": "krst vlkt brng zdpr hrmk tvrd plsk smrt chrt vrch".split()}


def text(lang, seed, n):
    draw = random.Random(f"{lang}{seed}")
    return " ".join(draw.choice(WORDS[lang]) + draw.choice(["", "a", "e", "i"]) for _ in range(n))


def test_run_equals_force(spark, tmp_path, monkeypatch):
    import sentencepiece

    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "SURE", 0.6)  # so few rows don't make the net surer
    rows = [(i, text(lang, i, 20 + i % 50), lang, "s", 0) for i, lang in enumerate(["xx", "yy"] * 150)]
    add = lambda t, lang=None: rows.append((len(rows), t, lang, "s", None))
    wrong = [len(rows) + k for k in range(3)]
    for k in range(3):
        add(text("xx", 900 + k, 80), "yy")  # a label that the text contradicts
    for t in (None, "", " 123 !", text("xx", 4, 24)):
        add(t)
    base = text("yy", 1000, 120).split()
    for k in range(4):  # near copies, and one that is not near enough
        add(" ".join(w if i != 10 * k + 5 else "other" for i, w in enumerate(base)))
    add(" ".join(w if i % 8 else "many" for i, w in enumerate(base)))
    item = text("xx", 2000, 40)
    add("before " + item + " after")
    add(" ".join(w if i != 3 else "changed" for i, w in enumerate(item.split()[:16])))
    add(text("yy", 3000, 30) + " token = abcdefghijklmnopqrst " + text("yy", 3001, 10), "yy")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if r[0] not in wrong and any(c.isalpha() for c in r[1] or "")]
    alone = {doc for doc, _, _, ok in components_by_force(kept, 5) if ok}
    kept = [r for r in kept if r[0] in alone]
    found = overlaps_by_force([(r[0], r[1].lower().split()) for r in kept], [(1, item.split())])
    kept = [r for r in kept if (r[0], 1) not in found]
    assert len(rows) - len(kept) == 3 + 3 + 1 + 3 + 2  # wrong labels, no letters, an exact copy, near copies, benchmark text
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = set()
    for doc, t, *_ in kept:
        clean = t.replace("token = abcdefghijklmnopqrst", "[secret]")
        ids = library.encode(clean, add_eos=True)
        expected.add((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == expected
