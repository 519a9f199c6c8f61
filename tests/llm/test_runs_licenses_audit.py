"""Periodic runs, license scan and filter audit: brute force, planted cases and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import filter_audit, license_scan, periodic_runs

DOC = "doc_id long, text string, lang string, source string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, nothing, white space, a very long text, rows that repeat, ids that repeat, clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e f g " * 60000), (6, "x y z q r s t"), (6, "x y z q r s t"), (6, "MIT license"), (None, "one two"), (None, "one two")]
    names = "doc_id long, text string, lang string, digest string, mask int, n long, words string, part string, runs int, held string, label int, word string"
    return spark.createDataFrame([(i, t, None, "d", 1, 1, "w", "p", 0, "h", 0, "w") for i, t in rows], names)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# 11


def lyndon(word):
    """Of each position, the longest piece that is smaller than all its own ends."""
    out = []
    for i in range(len(word)):
        pieces = [word[i:j] for j in range(i + 1, len(word) + 1)]
        out.append(max(len(p) for p in pieces if all(p < p[k:] for k in range(1, len(p)))))
    return out


def runs_by_definition(word, least):
    found, n = set(), len(word)
    for q in range(1, n // 2 + 1):
        for start in range(n - q):
            if start and word[start - 1] == word[start - 1 + q]:
                continue
            end = start + q
            while end < n and word[end] == word[end - q]:
                end += 1
            smaller = any(all(word[x] == word[x + r] for x in range(start, end - r)) for r in range(1, q))
            if end - start >= max(least, 2 * q) and not smaller:
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_of_both_orders():
    rng = random.Random(4)
    for _ in range(400):
        word = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 16))]
        ranks = sorted(set(word))
        for ordered in ([ranks.index(x) for x in word], [len(ranks) - 1 - ranks.index(x) for x in word]):
            assert periodic_runs.longest_lyndon(ordered, len(ranks)) == lyndon(ordered)


def test_runs_against_their_definition():
    rng = random.Random(5)
    for _ in range(400):
        word = [rng.randrange(rng.randint(1, 6)) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.5:
            piece = [rng.randrange(40) for _ in range(rng.randint(1, 9))]
            word += piece * rng.randint(1, 4) + word[:3]
        for least in (2, 5, 12):
            assert periodic_runs.runs_of_words([b"w%d" % x for x in word], least) == runs_by_definition(word, least)


def test_a_run_of_exactly_two_periods_has_one_single_pair_at_its_middle():
    piece = [b"w%d" % i for i in range(6)]
    assert periodic_runs.runs_of_words([b"x", *piece, *piece, b"y"]) == [(1, 12, 6)]
    assert periodic_runs.runs_of_words([b"x", *piece, *piece[:-1], b"y"]) == []


def expected_runs(doc_id, text):
    words = WORD.findall((text or "").encode())
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_definition(words, 12)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, *head, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "é ü é ü é ü é ü é ü é ü\n", "a\x1cb\x85c a"]
    for _ in range(120):
        words = [f"w{rng.randrange(rng.choice((3, 200)))}" for _ in range(rng.randint(1, 90))]
        texts.append(rng.choice((" ", "\n", "\t ")).join(words + words[-7:] * rng.randint(0, 3)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(docs))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected_runs(*r) for r in rows), key=str)


def test_runs_of_odd_tables(odd, none):
    got = {(r.doc_id, r.n_words): r for r in periodic_runs.periodic_runs(odd).collect()}
    assert [tuple(r) for r in got[5, 420000].runs] == [(0, 420000, 7)] and got[5, 420000].collapsed == "a b c d e f g"
    assert got[1, 0].runs == [] and got[1, 0].collapsed == "" and got[None, 2].collapsed == "one two"
    assert periodic_runs.periodic_runs(odd).count() == 10 and periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(none))).count() == 0


# 12

MIT = dict(license_scan.TEMPLATES)["mit"]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in license_scan.digest(license_scan.scan(docs)).orderBy("doc_id").collect()]


def labels_by_definition(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    shares = {}
    for label, template in license_scan.TEMPLATES:
        wanted = set(template.split())
        for i in range(0, max(len(words) - 101, 0) + 1, 100):
            shared = len(wanted & set(words[i : i + 200]))
            if 100 * shared >= 90 * len(wanted):
                shares[label] = max(shares.get(label, 0), shared / len(wanted))
    starts = [i for i, _ in places]
    base, score = {x for _, x in places}, 1.0 if places else max(shares.values(), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(shares))), score


def test_licenses_against_every_block_and_template(spark):
    rng, texts = random.Random(7), [None, "", "MİT license", "mit license, MIT\nLicense! mit license", "cc by cc by", "worK mit"]
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    for _, template in license_scan.TEMPLATES:
        words = template.split()
        for lost in range(6):  # around the threshold, which a tie just meets
            kept = [w for w in words if w not in rng.sample(sorted(set(words)), lost)]
            rng.shuffle(kept)
            before = [rng.choice(["lorem", "ipsum", "the", "of", "é"]) for _ in range(rng.randint(0, 350))]
            after = [rng.choice([*vocabulary, "dolor"]) for _ in range(rng.randint(0, 30))]
            texts.append(" ".join([*before, *kept, *after]).title())
    got = [tuple(r)[1:] for r in scanned(spark, texts)]
    assert got == [labels_by_definition(t) for t in texts]


def test_a_statement_across_blocks_and_lines_is_found(spark):
    for before in (95, 150, 199, 260):
        text = "\n".join(["lorem"] * before + MIT.split() + ["ipsum"] * 300)
        assert scanned(spark, [text])[0].labels == "mit"


def test_licenses_of_odd_tables(odd, none):
    got = [(r.doc_id, r.n_words, r.n_base, r.labels) for r in license_scan.digest(license_scan.scan(odd)).collect()]
    expected = [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 0, ""), (5, 420000, 0, ""), *[(6, 7, 0, "")] * 2, (6, 2, 1, "mit"), *[(None, 2, 0, "")] * 2]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert license_scan.digest(license_scan.scan(none)).count() == 0


def test_license_scan_needs_no_python_worker(spark, odd):
    plan = license_scan.digest(license_scan.scan(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# 13


def masks_by_definition(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(
            name
            for name, bad in zip(
                "ABCDE",
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                    bool(re.search(r"[#$%&*|]", text)),
                    doc_id is not None and doc_id > first[text],
                ),
                strict=True,
            )
            if bad
        )
        out.append((doc_id, lang or "", fails))
    return out


def steps_by_definition(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masked, out = masks_by_definition(rows), []
    for part in {p for _, p, _ in masked}:
        inside = [(i, fails) for i, p, fails in masked if p == part]
        mine, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = inside
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(gone)
                redundant = sum(name in f for _, f in inside) - len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone), redundant, sum(f == name for _, f in inside), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def test_audit_against_every_order_applied(spark):
    rng, texts = random.Random(8), [None, "", "ABC def", "x" * 10]
    for _ in range(40):
        words = [f"w{rng.randrange(rng.choice((20, 2000)))}" for _ in range(rng.choice((50, 199, 200, 201, 260)))]
        text = " ".join(words)
        texts.append(text.upper() if rng.random() < 0.2 else text + rng.choice(["", "", " #", " 5%"]))
    texts += ["A" * 3 + "b" * 97, "A" * 4 + "b" * 96, " ".join(["a", "b"] * 100), " ".join([f"w{i}" for i in range(100)] * 2)]
    rows = [(rng.choice([None, *range(30)]), t, rng.choice(["en", "de", None, ""])) for t in texts * 3]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(docs, marked).collect())) == steps_by_definition(rows, labels)


def test_neighbouring_levels_are_exchanged_until_all_orders_have_come():
    counts = {m: (m * m % 7, m % 2, m % 3) for m in range(32)}
    diagram = filter_audit.Diagram(counts, "ABCDE")
    seen = {"".join(diagram.order)}
    for level in filter_audit.neighbour_swaps(5):
        diagram.swap(level)
        seen.add("".join(diagram.order))
        failed = 0
        for name, kept, _ in diagram.steps():
            failed |= 1 << "ABCDE".index(name)
            assert kept == tuple(sum(c[k] for m, c in counts.items() if not m & failed) for k in range(3))
    assert len(seen) == 120


def test_equal_parts_of_a_diagram_are_one_node():
    diagram = filter_audit.Diagram({}, "ABCDE")
    assert diagram.root.passing is diagram.root.failing and diagram.root.counts == ()


def test_audit_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0, 9), (6, 0, 0, 9)], "doc_id long, quality int, toxic int, good int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    got = sorted(map(tuple, filter_audit.audit(odd, labels).collect()))
    assert got == steps_by_definition(rows, [(6, 1, 0)]) and len(got) == 600
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.failure_counts(odd, labels.limit(0)).agg(F.sum("docs")).first()[0] == 10
