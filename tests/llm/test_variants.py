import random
import re
import zlib
from collections import Counter, defaultdict

from lexloom.llm import variants

SCHEMA = "doc_id bigint, text string, word string, n string, place int"


def words_of(rows):
    counts = Counter()
    for n, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{n}:{run}".encode())
            if n is not None and code % 97 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    return {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    partners = defaultdict(list)
    for a in counts:
        for b in counts:
            if a != b and abs(len(a) - len(b)) < 2 and near(a, b):
                partners[a].append(b)
    best = {a: min(own, key=lambda b: (-counts[b], b)) for a, own in partners.items()}
    form = {a: b for a, b in best.items() if counts[b] >= 2 * counts[a]}
    out = []
    for a in counts:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, counts[a], len(partners[a]), counts[form[a]] if a in form else None))
    return out


def query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "w", "n", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(str, (tuple(r) for r in variants.op13_variants(spark, str(tmp_path)).collect())))


def test_query(spark, folder, rows):
    own = sorted(map(str, (tuple(r) for r in variants.op13_variants(spark, folder).collect())))
    assert own == sorted(map(str, brute(words_of([r[:2] for r in rows]))))


def test_edits_ties_chains_and_letters(spark, tmp_path):
    """Words of few letters, so that most are near others; equal counts; chains of forms; repeated letters; letters outside a-z; repeated and null rows."""
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 8))) for _ in range(120)]
    pool += ["hello", "hallo", "helllo", "hhello", "hell", "Grüße", "grüsse", "groß", "naïve", "naive", "x" * 300, "x" * 301, "x" * 299 + "y"]
    rows = []
    for i in range(300):
        text = " ".join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in rnd.choices(pool, [1 / (1 + j % 40) for j in range(len(pool))], k=40))
        rows.append((None if i % 40 == 3 else 7 if i % 3 == 0 else i, text))
    rows += [(1, None), (2, ""), (3, "1 2 -- "), (4, "same words here " * 4), (4, "same words here " * 4)]
    counts = words_of(rows)
    known = brute(counts)
    assert sum(r[1] is not None for r in known) > 20 and any(r[1] not in (None, r[2]) for r in known)
    assert query(spark, tmp_path, rows) == sorted(map(str, known))


def test_long_words_and_texts(spark, tmp_path):
    a = "ab" * 4000
    rows = [(i, f"{a} {a[:-1]} {a}c " * 2) for i in range(3)] + [(9, "word, " * 200_000)]
    assert query(spark, tmp_path, rows) == sorted(map(str, brute(words_of(rows))))


def test_nothing_to_group(spark, tmp_path):
    assert query(spark, tmp_path, [(1, "few words"), (2, None)]) == []
    assert variants.counted(variants.observed(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_chain_ends_at_its_last_form(spark, tmp_path):
    folder = f"file://{tmp_path}"
    names = ["abcde" + "x" * i for i in range(7)]
    counts = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(names)], "word string, n bigint")
    out = {r.word: r for r in variants.grouped(counts, folder).collect()}
    assert {r.root for r in out.values()} == {names[-1]} and out[names[0]].form == names[1] and out[names[-1]].form is None


def test_the_vocabulary_is_not_broadcast(spark, folder, tmp_path):
    """However few bytes its files have."""
    words = spark.createDataFrame([(i, f"word{i}", 3) for i in range(9)], "place bigint, word string, n bigint")
    words.write.parquet(f"{tmp_path}/words")
    stored = spark.read.parquet(f"{tmp_path}/words")
    for own in (variants.shortened(stored), variants.grouped(stored.select("word", "n"), f"file://{tmp_path}/run"), variants.op13_variants(spark, folder)):
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
