"""Operator 13: base spans against plain regular expressions, the fits against loops, added spans on made texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import personal
from tests.llm.conftest import make

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else True


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def contract(rows):
    out = Counter()
    for doc_id, text, *_ in rows:
        spans = base(text)
        n = Counter(k for k, _, _ in spans)
        out[doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    return out


def run(spark, tmp_path, rows):
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = personal.op13_weak_supervision_pii(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    return found.collect()


def listed(spans):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


@pytest.fixture(scope="module")
def odd():
    """Texts that put each pattern's edges to the test, and pieces of them in random order."""
    rng = random.Random(4)
    pieces = ["a", "Z", "é", "😀", "@", ".", "-", "_", "%", "+", "+1", " ", "  ", "(", ")", "0", "5", "25", "255", "256", "4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1112", "1.2.3.4", "9.9.9.9.9", "a@b.c", "x@y", "b.co_d@e.f", "\n", "+49 (30) 1234", "+123456789012345678"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    texts += ["a@b.c_d@e.f", "a@b@c.d", "u@h..x", "u@-.-", "+1-(", "+1 2", "1.2.3.4.5.6.7.8", "00255.000.1.1", "12345678901234567890", "1 2-3 4", "4" * 16, "0" * 16 + " - 1", "é+1 (555) 123-4567é", None, "", "ＡＢ@c.d", "١٢٣٤@x.y"]
    return texts


def test_base_spans(spark, tmp_path, odd, edge_rows):
    long = "w" * 2000 + " a@" + "b." * 8000 + "c 1.1.1.1 " + "7" * 2000 + " +" + "1" * 20_000 + " x@y.zz " * 700
    rows = [(i, t, "en", "a") for i, t in enumerate(odd)] + [(9999, long, "en", "a"), (9998, long, "en", "a")] + [(None, "q@r.st", None, None)] * 2 + list(edge_rows)
    got = run(spark, tmp_path, rows)
    assert Counter(tuple(r)[:6] for r in got) == contract(rows)
    order = list(personal.KINDS)
    texts = Counter(i for i, *_ in rows)
    texts = {i: t for i, t, *_ in rows if i is not None and texts[i] == 1}
    for r in got:
        if r.doc_id not in texts:
            continue
        spans = listed(r.spans)
        assert spans == sorted(spans, key=lambda s: (order.index(s[0]), s[1])) and [s for s in spans if s[0] in PLAIN] == base(texts[r.doc_id])
        added = [s for s in spans if s[0] not in PLAIN]
        assert all(b <= c or d <= a for _, a, b in added for _, c, d in base(texts[r.doc_id]))


PERSONAL = [
    ("mail", "please write to {} today", "jane.doe (at) example (dot) org"), ("mail", "my e-mail is {} and", "bob at example dot com"), ("mail", "contact {} please", "kim[at]mail[dot]example[dot]net"),
    ("call", "call me on phone {} after six", "(212) 555-0187"), ("call", "tel. {} or", "415-555-2671"), ("call", "Telefon {} ab", "030 123 45678"),
    ("ssn", "her social security number is {} as", "123-45-6789"), ("ssn", "SSN {} on file", "517-22-9041"),
    ("iban", "pay to account {} by Friday", "DE89 3704 0044 0532 0130 00"), ("iban", "IBAN {} ok", "GB82WEST12345698765432"),
    ("name", "yours sincerely, signed by {} yesterday", "Dr. Maria Keller"), ("name", "the patient, {} came", "Mr. John Smith"), ("born", "she was born on {} in", "12.03.1984"), ("born", "date of birth: {} end", "1990-07-21"),
]
HARMLESS = [
    "version 12.03.1984 of the build", "order 415-555-2671 items", "isbn 978-3-16-148410-0 is a book", "published 2019-05-17 in print", "we met at the inn at noon dot matrix", "a total of 123 456 7890 kg was sold", "SSN 000-12-3456 is none",
    "part no 123-45-6789 fits", "IBAN DE89 3704 0044 0532 0130 01 is wrong", "on page 212 555 0187 of it", "the years 1914-1918 and 1939-1945", "Mr and Mrs of the house", "pi is 3.14159 and 2.71828", "from 10:30 to 12:45, rooms 101-105", "sections 12.3.4 and 12.3.5",
]


def test_added_spans(spark, tmp_path):
    rows, want = [], {}
    for i in range(140):  # each kind of text ten times, with words about it
        kind, frame, value = PERSONAL[i % len(PERSONAL)]
        text = f"Some words {i}. " + frame.format(value) + " so it goes."
        rows.append((i, text, "en", "a"))
        want[i] = (kind, text.index(value), text.index(value) + len(value))
    rows += [(1000 + i, f"{HARMLESS[i % len(HARMLESS)]} ({i}).", "en", "b") for i in range(10 * len(HARMLESS))]
    rows += [(5000 + i, f"reach us: info{i}@example.com or +1 (555) 123-{1000 + i}, card 4111111111111111, host 10.0.0.{i % 250}", "en", "c") for i in range(60)]
    got = {r.doc_id: listed(r.spans) for r in run(spark, tmp_path, rows)}
    missed = [i for i, s in want.items() if s not in got[i]]
    flagged = [i for i in range(1000, 1000 + 10 * len(HARMLESS)) if got[i]]
    assert not missed, [rows[i][1] for i in missed[:5]]
    assert not flagged, [HARMLESS[(i - 1000) % len(HARMLESS)] for i in flagged[:20]]


def test_running_sums(spark):
    rows = [[], [5], list(range(1, 2000)), [0] * 600]
    df = spark.createDataFrame([(v,) for v in rows], "v array<long>")
    for v, s in df.select("v", personal.running(F.col("v"), 256)).collect():
        assert s == [sum(v[: i + 1]) for i in range(len(v))] if len(v) < 100 else (s[0], s[-1], s[700 % len(v)]) == (v[0], sum(v), sum(v[: 700 % len(v) + 1]))


def test_checks(spark):
    texts = ["4111111111111111", "4111 1111 1111 1112", "5500-0000-0000-0004", "0"]
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "GB82WEST12345698765432"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", personal.luhn(F.col("t"))).collect()
    assert dict(map(tuple, got)) == dict(zip(texts, (True, False, True, True)))
    got = spark.createDataFrame([(t,) for t in ibans], "t string").select(personal.mod97(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, True]


def em(patterns):
    """The model by plain loops: log odds of each labeler's votes, and of a candidate as such."""
    odds = [[math.log(personal.PRIOR_YES[v] / personal.PRIOR_NO[v]) for v in (-1, 0, 1)] for _ in personal.LABELERS]
    kind = 0.0
    for _ in range(personal.EM_STEPS):
        qs = [1 / (1 + math.exp(-kind - sum(o[x + 1] for o, x in zip(odds, v)))) for v, _ in patterns]
        yes, no = [n * q for (_, n), q in zip(patterns, qs)], [n * (1 - q) for (_, n), q in zip(patterns, qs)]
        new = []
        for j, doubt in enumerate(personal.MOST_DOUBT):
            rates = []
            for weight, prior in ((yes, personal.PRIOR_YES), (no, personal.PRIOR_NO)):
                cast = [prior[x] * personal.PRIOR_VOTES + sum(w for (v, _), w in zip(patterns, weight) if v[j] == x) for x in (-1, 0, 1)]
                rates.append([c / sum(cast) for c in cast])
            ratio = [math.log(a / b) for a, b in zip(*rates)]
            nothing = math.log(personal.LEAST_NOTHING)
            new.append([min(ratio[0], math.log(doubt)), max(nothing, min(-nothing, ratio[1])), max(ratio[2], math.log(personal.LEAST_FAITH))])
        odds = new
        kind = max(-personal.MOST_KIND, min(personal.MOST_KIND, math.log((sum(yes) + personal.PRIOR_KIND) / (sum(no) + personal.PRIOR_KIND))))
    return odds, kind


def test_reliabilities_are_found(spark):
    """EM equals a plain loop, orders labelers by how often they are right, and judges candidates by them."""
    rng, rates, made = random.Random(7), [0.97, 0.95, 0.9, 0.8, 0.7, 0.6], Counter()
    for _ in range(2000):
        truth = 1 if rng.random() < 0.4 else -1
        made[tuple(0 if rng.random() < 0.2 else truth if rng.random() < r else -truth for r in rates), truth] += 1
    counts = Counter()
    for (v, _), n in made.items():
        counts[v] += n
    patterns = [(list(v), float(n)) for v, n in sorted(counts.items())]
    df = spark.createDataFrame([(patterns,)], "patterns array<struct<votes:array<int>,n:double>>")
    got = df.select(personal.reliabilities(F.col("patterns")).alias("m")).select("m.*").first()
    odds, kind = em(patterns)
    assert max(abs(a - b) for x, y in zip(got.odds, odds) for a, b in zip(x, y)) < 1e-9 and abs(got.kind - kind) < 1e-9
    assert [o[2] for o in odds[:5]] == sorted((o[2] for o in odds[:5]), reverse=True)
    wrong = sum(n for (v, truth), n in made.items() if (kind + sum(o[x + 1] for o, x in zip(odds, v)) > 0) != (truth > 0))
    assert wrong < 0.1 * 2000


def test_weights_are_the_best(spark):
    """The fit's slope vanishes: no other weights have a smaller penalised loss."""
    rng = random.Random(8)
    rows = [([1.0] + [float(rng.random() < 0.4) for _ in range(4)], float(rng.randrange(1, 50)), rng.random()) for _ in range(40)]
    df = spark.createDataFrame([(rows,)], "p array<struct<shape:array<double>,n:double,q:double>>")
    w = df.select(personal.weights(F.col("p"), 5).alias("w")).first().w
    p = lambda f: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f))))
    for j in range(5):
        assert abs(sum(n * (q - p(f)) * f[j] for f, n, q in rows) - personal.SHRINK * w[j]) < 0.05


def test_no_rows(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert personal.op13_weak_supervision_pii(spark, str(tmp_path)).count() == 0


def test_long_runs(spark):
    """Runs without an end that fits: the plain forms would go back over them again and again."""
    text = "w" * 100_000 + " a@" + "b." * 50_000 + "\n" + "7" * 100_000 + " +" + "1" * 100_000 + "( " * 50_000
    row = personal.candidates(make(spark, [(1, text, "en", "a")])).first()
    assert row.base == [("email", 100_001, 200_002)]


def test_native(spark, edge):
    """The main path's plan holds no Python."""
    plan = personal.personal_spans(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
