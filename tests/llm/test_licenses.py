import random
import re
import textwrap
import time

from tidemark.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, needed, op10_license_scan, places, scan_licenses, words_of

SCHEMA = "doc_id long, text string, labels string, id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    out = []
    for i, t, *_ in rows:
        words = WORD.findall(low(t or ""))
        base = []
        for p, label in PHRASES.items():
            p = p.split()
            base += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        found = {}
        for line in low(t or "").split("\n"):
            have = set(WORD.findall(line))
            for label, text in TEMPLATES.items():
                want = set(WORD.findall(low(text)))
                if len(want & have) >= needed(len(want), CONTAINMENT):
                    found[label] = max(found.get(label, 0), len(want & have) / len(want))
        labels = {x for _, x in base}
        at = [k for k, _ in base]
        out.append((i, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), max([float(bool(base)), *found.values()])))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    pieces = [*TEMPLATES.values(), *PHRASES, "é漢", "THE", "MIT", "cc", "by", "license", "\n", "\x00", "under", "the gnu", "  ", "x-y"]
    rows = [(i, " ".join(r.choice(pieces) if r.random() < 0.6 else r.choice(r.choice(pieces).split() or [""]) for _ in range(r.randint(0, 25))), "a", 1) for i in range(300)]
    rows += [(900, None, None, None), (901, "", "", 1), (None, "cc by cc by", "", 1), (902, "MIT LICENSE " * 20000, "", 1), (902, "mit-license", "", 1)]
    assert sorted(map(tuple, scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapped_notices(spark, tmp_path):
    rows = [(i, "Some file\n\n" + textwrap.fill(t, w, initial_indent=mark, subsequent_indent=mark) + "\nint x;", "a", 1) for i, (t, w, mark) in enumerate((t, w, m) for t in TEMPLATES.values() for w in (30, 72) for m in ("", " * ", "# "))]
    rows.append((900, "\n".join(w + " filler" * 40 for w in TEMPLATES["bsd-notice"].split()), "a", 1))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_license_scan(spark, str(tmp_path)).collect()}
    for i, label in enumerate(x for x in TEMPLATES for _ in range(6)):
        assert label in got[i].labels.split(",") and got[i].score == 1
    assert got[900].labels == "" and got[900].score == 0


def test_wrapped_against_every_run(spark):
    r = random.Random(5)
    pieces = [*TEMPLATES.values(), "é漢", "MIT", "license", "under", "the gnu"]
    rows = [(i, re.sub(" ", lambda _: r.choice([" ", " ", "\n"]), " ".join(w for w in " ".join(r.choice(pieces) for _ in range(r.randint(0, 6))).split() if r.random() < 0.85)), "a", 1) for i in range(150)]
    lines = {i: (set(filter(None, labels.split(","))), score) for i, *_, labels, score in brute(rows)}
    got = {x.doc_id: (set(filter(None, x.labels.split(","))), x.score) for x in scan_licenses(spark.createDataFrame(rows, SCHEMA), wrapped=True).collect()}
    more = 0
    for i, text, *_ in rows:
        words, (labels, score) = WORD.findall(text.lower()), lines[i]
        labels = set(labels)
        for label, t in TEMPLATES.items():
            own = WORD.findall(t.lower())
            best = max([len(set(own) & set(words[k : k + len(own)])) for k in range(len(words))], default=0)
            if best >= needed(len(set(own)), CONTAINMENT):
                more += label not in labels
                labels.add(label)
                score = max(score, best / len(set(own)))
        assert got[i] == (labels, score)
    assert more


def test_many_places_take_time_in_proportion():
    words = words_of("apache license " * 160_000)
    began = time.thread_time()
    got = places(words)
    assert time.thread_time() - began < 3
    assert got == [(2 * i, "apache") for i in range(160_000)]
