"""Personal data, language identification, packing, and the pipeline."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cautela.llm import language_id
from cautela.llm.common import Scratch, table
from cautela.llm.language_id import RIDGE, UNKNOWN, fit_kernel_model, held_out, identify, learn_languages, presence, training_sample
from cautela.llm.packing import SIZES, cost, pack, pack_documents, pack_lengths, pack_once
from cautela.llm.personal_data import KINDS, find_personal_data, fit_spans, mask_personal_data, written
from cautela.llm.queries import BYTE_BPE, QUERIES
from cautela.llm.token_files import token_index, write_token_files

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


BITS = (
    "a @ b.c . .. 1.2.3.4 256.1.1.1 é 4111111111111111 - + 9 x_y% (at) password=abc12345 12.34.56.78.90.12.34.5 a@b.co @c.d 😀"
    " 0001.2.3.255 5500-0000-0000-0004 +15555550199"
).split() + [" ", "\n", "4111 1111 1111 1111", "+1 (555) 555-0199"]


def test_base_spans_equal_plain_matching(spark, sf):
    pick = random.Random(5)
    texts = ["".join(pick.choice(BITS) for _ in range(pick.randint(0, 25))) for _ in range(1_500)]
    texts += [None, "", "a@b.c " * 700 + "1.2.3.4 é" * 300, "a" * 100_000 + "@b.c", "1" * 50_000, "a@b" + ".c" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    frame = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    found = frame.select("doc_id", written(F.col("personal_data.base")).alias("b"), written(F.col("personal_data.spans")).alias("s"))
    expected = {i: base_spans(t) for i, t in rows}
    for r in found.collect():
        assert r.b == ",".join(expected[r.doc_id]), r.doc_id
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_added_spans_and_masks(odd, none):
    found = {r.doc_id: r for r in find_personal_data(odd).collect()}
    kinds = [KINDS[s.kind] for s in found[9].personal_data.spans]
    assert kinds == ["email", "phone", "ip", "card"]
    assert [KINDS[s.kind] for s in found[12].personal_data.spans] == ["secret"] * 3 and found[12].personal_data.base == []
    masked = mask_personal_data(odd)
    assert masked.columns == odd.columns
    texts, before = {r.doc_id: r.text for r in masked.collect()}, {r.doc_id: r.text for r in odd.collect()}
    assert texts[9] == "write to <email> or <phone> now, <ip>, <card>"
    assert texts[12].startswith("<secret> and the rest") and all(texts[i] == before[i] for i in texts if i not in (9, 12, None))
    assert find_personal_data(none).count() == 0 == mask_personal_data(none).count()


def test_numbers_that_run_together_are_caught(spark):
    text = "call +1 (555) 555-0199 4111111111111111 now"
    rows = [(i, f"mail a{i}@b.com, card 4111111111111111, secret password=ab12cd34ef56") for i in range(50)] + [(99, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert base_spans(text) == []
    assert {r.doc_id: r.text for r in mask_personal_data(frame).collect()}[99] == "call <phone> <card> now"


def test_votes_are_weighed():
    row = lambda votes, n: dict(zip(("kind", "regex", "gazetteer", "context", "shape", "long", "n"), (2, *votes, 1, n)))  # noqa: E731, B905
    model = fit_spans([row((1, 1, 0, 1), 900), row((-1, -1, 0, 1), 300), row((1, 1, 1, 1), 100), row((-1, -1, -1, 0), 50)])
    w = model.weights[2]
    score = lambda votes: sum(a * b for a, b in zip(w, (*votes, 1, 1), strict=True))
    assert score((1, 1, 0, 1)) > 0 > score((-1, -1, 0, 1)) and all(0.5 < r < 1 for r in model.reliability.values())
    assert fit_spans([]).weights == {}


def test_language_id(spark, sf, odd, none):
    frame = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = frame.collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    model = learn_languages(table(spark, sf, "documents"))
    told = identify(odd, model)
    assert told.columns == [*odd.columns, "language_id"] and told.count() == odd.count()
    assert {r.doc_id for r in told.collect() if r.language_id.language == UNKNOWN} == {4, 5, 8, 11, None}
    assert identify(none, model).count() == 0
    nothing = learn_languages(none.withColumn("lang", F.lit("en")))
    assert nothing is None and identify(odd, nothing).filter("language_id.score > 0").count() == 0


def test_training_leaves_the_held_out_fold_alone(spark):
    rows = [(i, "wort " * 3 if held else "word " * 3, "xx" if held else "en") for i, held in ((i, False) for i in range(200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spoiled = frame.withColumn("lang", F.when(held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert learn_languages(spoiled).languages == ["en"]
    assert len(training_sample(frame.union(frame), "text", "lang", "doc_id")) == 200  # repeated rows count once
    assert fit_kernel_model([("123", "en")]) is None


def letter_grams(text):
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    letters = re.sub(" +", " ", letters).lstrip(" ") + " "
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)} - {" "}


def test_kernel_and_weights_by_definition():
    pick = random.Random(9)
    word = lambda letters: "".join(pick.choice(letters) for _ in range(pick.randint(1, 7)))
    texts = [" ".join(word("abcdé" if i % 2 else "xyzaß") for _ in range(pick.randint(1, 40))) for i in range(60)] + ["中文 한국", "a", "A1b,,c"]
    found, letters = presence(texts)
    sets = [letter_grams(t) for t in texts]
    assert letters.all() and all(len(s) - 2 <= n <= len(s) for n, s in zip(found.sum(axis=1), sets, strict=True))
    common = found.astype(int) @ found.T.astype(int)
    plain = np.array([[len(a & b) for b in sets] for a in sets])
    assert np.abs(common - plain).max() <= 2 and (common >= plain).all()  # a few n-grams of all share a place
    rows = [(t, "odd" if i % 2 else "even") for i, t in enumerate(texts[:60])]
    model = fit_kernel_model(rows)
    sizes = found.sum(axis=1)[:60]
    gram = common[:60, :60] / np.sqrt(np.outer(sizes, sizes))
    # All texts are landmarks, so this is kernel ridge regression on the whole kernel (directions above the rank).
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    features = vectors[:, keep] * np.sqrt(values[keep])
    y = np.array([[language == "even", language == "odd"] for _, language in rows], float)
    plain = features @ np.linalg.solve(features.T @ features + RIDGE * 60 * np.eye(keep.sum()), features.T @ y)
    assert np.allclose(model.scores(texts[:60])[0], plain, atol=1e-3)


SCRIPTS = {
    "latin": "abcdefghijklmnopqrst", "latin2": "uvwxyzäöüßéèêçñó", "greek": "αβγδεζηθικλμνξοπρ", "cyrillic": "абвгдежзийклмнопр",
    "arabic": "ابتثجحخدذرزسشصضط", "devanagari": "कखगघचछजझटठडढतथदध", "thai": "กขคงจฉชซญดตถทธนบ", "hangul": "가나다라마바사아자차카타파하고노",
    "hiragana": "あいうえおかきくけこさしすせそた", "han": "的一是不了人我在有他这为之大来以", "han2": "水火木金土日月山川田石花草虫鱼鸟",
}


def test_presence_is_held_as_numbers_in_parts_and_texts_handed_over_once(spark, monkeypatch):
    pick = np.random.default_rng(5)
    found, landmarks = pick.random((7, 100)) < 0.5, pick.random((5, 100)) < 0.5
    whole = language_id.kernel(found, found.sum(axis=1), landmarks, landmarks.sum(axis=1))
    monkeypatch.setattr(language_id, "COLUMNS", 9)
    parts = language_id.kernel(found, found.sum(axis=1), landmarks, landmarks.sum(axis=1))
    assert (whole == parts).all() and whole[2, 3] > 0
    rows = spark.createDataFrame([("x", 1)], "text string, id long")
    plan = language_id.identify(rows, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _row" in plan and "AS _text" not in plan
    assert language_id.identify(rows, None, keep_text=False).first() == (1, ("und", 0.0))


def test_languages_of_every_script_are_told_apart(spark):
    pick, rows = random.Random(2), []
    for name, letters in SCRIPTS.items():
        for _ in range(150):
            words = ("".join(pick.choice(letters) for _ in range(pick.randint(1, 6))) for _ in range(pick.randint(3, 30)))
            rows.append((len(rows), " ".join(words), name))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", held_out("doc_id"))
    told = identify(frame, learn_languages(frame)).filter("held").collect()
    assert len(told) > 300 and sum(r.language_id.language == r.lang for r in told) >= 0.98 * len(told)
    many = frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).filter("doc_id % 40 < 2").drop("copy")
    sample = training_sample(many, "text", "lang", "doc_id")
    assert len(sample) == many.select("doc_id").distinct().count()  # repeated rows count once, none is lost


def test_any_number_of_languages_is_learned(monkeypatch):
    monkeypatch.setattr(language_id, "ALL_LANDMARKS", 40)
    letters = [chr(0x4E00 + i) for i in range(700)]
    rows = [(" ".join(letters[7 * k + (j + i) % 7] * 2 for j in range(9)), f"l{k:03}") for k in range(100) for i in range(3)]
    model = fit_kernel_model(rows)
    assert len(model.languages) == 100 and len(model.landmarks) <= 40


def exhaustive(lengths, sizes):
    """Least cost over all partitions of a few items."""
    if not lengths:
        return 0.0
    best, (first, *rest) = float("inf"), lengths
    for mask in range(1 << len(rest)):
        inside = first + sum(x for i, x in enumerate(rest) if mask >> i & 1)
        size = next((s for s in sizes if s >= inside), None)
        if size is not None:
            best = min(best, cost(size) + exhaustive([x for i, x in enumerate(rest) if not mask >> i & 1], sizes))
    return best


def test_packing_is_valid_and_near_the_best():
    pick, sizes = random.Random(6), (16, 32, 64)
    for _ in range(60):
        lengths = sorted((pick.randint(1, 64) for _ in range(pick.randint(1, 7))), reverse=True)
        bins, starts, final = pack(lengths, sizes)
        filled = [0] * len(final)
        for length, at, start in zip(lengths, bins, starts, strict=True):
            assert start == filled[at]
            filled[at] += length
        assert all(f <= c and c == next(s for s in sizes if s >= f) for f, c in zip(filled, final, strict=True))
        assert exhaustive(lengths, sizes) <= sum(map(cost, final)) <= 1.7 * exhaustive(lengths, sizes)
        assert sum(map(cost, final)) <= min(sum(map(cost, pack_once(lengths, sizes, s)[2])) for s in sizes)


def test_packing_of_tables(spark, odd, none):
    lengths = spark.createDataFrame([(1, 20_000), (2, 8_192), (3, 1), (3, 1), (None, 5), (4, 700)], "doc_id long, length long")
    rows = pack_lengths(lengths, Scratch(spark, "test")).collect()
    assert sorted(r.n_tokens for r in rows if r.doc_id == 1) == [20_000 - 2 * 8_192, 8_192, 8_192]
    assert sum(r.n_tokens for r in rows) == 20_000 + 8_192 + 7 + 700 and {r.capacity for r in rows} <= set(SIZES)
    for bin_id in {r.bin_id for r in rows}:
        inside = sorted((r.start, r.n_tokens) for r in rows if r.bin_id == bin_id)
        assert [s for s, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]
    found = pack_documents(odd, BYTE_BPE).collect()
    assert len({(r.bin_id, r.start) for r in found}) == len(found) >= odd.count()
    assert [r.n_tokens for r in found if r.doc_id in (4, 5)] == [1, 1]
    assert pack_documents(none, BYTE_BPE).count() == 0


def test_packed_lengths_are_those_of_the_ids(spark, sf, odd, tmp_path):
    texts = [(20_000, "a\n\n  b\t\tc 123 x.y,z 'tis\n" * 900), (20_001, "word\n" * 9_000), (20_002, "\u4e2d\u6587 \U0001f600" * 50)]
    frame = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    for n, rows in enumerate((frame, odd.select("doc_id", "text"))):
        write_token_files(rows, str(tmp_path / str(n)), BYTE_BPE)
        written_ids = sorted((r.doc_id or -1, r.n_tokens) for r in token_index(spark, str(tmp_path / str(n))).collect())
        packed, filled, capacity, total = pack_documents(rows, BYTE_BPE).collect(), {}, {}, {}
        for r in packed:
            filled[r.bin_id] = filled.get(r.bin_id, 0) + r.n_tokens
            capacity[r.bin_id] = r.capacity
            total[r.doc_id or -1] = total.get(r.doc_id or -1, 0) + r.n_tokens
        expected = {}
        for i, n_tokens in written_ids:
            expected[i] = expected.get(i, 0) + n_tokens
        assert total == expected and all(filled[b] <= capacity[b] for b in filled)


def test_long_secrets_and_addresses_are_whole(spark):
    token, address = "aB3_" * 250, "n" * 100 + " (at) a.b.c.d.e.f." + "g" * 80 + ".com"
    rows = [(1, f"token={token} end"), (2, f"write to {address} now"), (3, f"api_key: '{token}.{token}.{token}'\nend")]
    rows += [(i, f"secret password=ab{i}cd34ef56 and so on") for i in range(10, 40)]
    masked = {r.doc_id: r.text for r in mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [masked[i] for i in (1, 2, 3)] == ["<secret> end", "write to <email> now", "<secret>\nend"]


def test_pipeline(spark, sf):
    documents, scratch = table(spark, sf, "documents"), Scratch(spark, "test")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf))
        assert docs.columns == documents.columns, name
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    assert docs.filter(F.char_length("text") != F.col("n_chars")).isEmpty()
    assert not any(base_spans(r.text) for r in docs.collect())
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_query_op4_digests(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op4_personal_data"](spark, sf).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in KINDS[:4]]
