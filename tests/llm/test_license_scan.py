"""License scan: exact containment in windows, long notices by bands, defined cases."""

from __future__ import annotations

import random
import re

import pytest

from tickloom.llm import license_scan as ls


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def slow(docs):
    out = {}
    for d, t in docs:
        w = words(t)
        sh = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        for name, text in ls.TEMPLATES.items():
            tw = words(text)
            own = {tuple(tw[i:i + 5]) for i in range(len(tw) - 4)}
            s = 64 if len(own) >= 32 else 1 << (len(own) - 1).bit_length()
            if len(own) > 64:
                s = max(len(sh), 1)
            best = max((len(own & set(sh[k:k + 2 * s - 1])) / len(own) for k in range(0, len(sh), s)), default=0)
            if best >= 0.8:
                out[(d, name)] = max(round(best, 6), out.get((d, name), 0))
    return out


@pytest.fixture
def templates(spark):
    return spark.createDataFrame(list(ls.TEMPLATES.items()), "license string, text string")


def test_matches_brute_force(spark, templates):
    rng, docs = random.Random(3), []
    notices = list(ls.TEMPLATES.values())
    for d in range(150):
        body = [f"x{rng.randrange(500)}" for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(notices).split()
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = notice
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "one two"), (903, notices[0].upper() + "!!"), (903, "and " + notices[1]), (None, notices[6]), (904, (notices[6] + "\n") * 300)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = {(r.key, r.license): round(r.containment, 6) for r in ls.scan(df, templates).collect()}
    assert got == slow(docs) and len(got) > 50
    assert ls.scan(df.limit(0), templates).count() == 0 and ls.scan(df, templates.limit(0)).count() == 0


def test_templates_are_bounded(spark):
    long = spark.createDataFrame([("x", " ".join(f"w{i}" for i in range(ls.MOST_SHINGLES + 5)))], "license string, text string")
    with pytest.raises(ValueError):
        ls.template_bands(long)


def test_whole_texts_of_any_length(spark):
    """Templates at the lengths where rules change, and of thousands of words: found where 0.8 is there, not found at 0.7."""
    rng = random.Random(11)
    made = {f"t{n}": [f"{rng.randrange(900)}q{n}" for _ in range(n + 4)] for n in (1, 2, 31, 32, 33, 63, 64, 65, 128, 129, 1000, 6000)}
    templates = spark.createDataFrame([(k, " ".join(w)) for k, w in made.items()], "license string, text string")
    docs, want = [], {}
    for d in range(120):
        name = rng.choice(sorted(made))
        text, kept = list(made[name]), rng.choice([1.0, 0.9, 0.7])
        if kept < 1 and len(text) > 20:  # a stretch in the middle is other words
            cut = int((1 - kept) * len(text))
            text[len(text) // 2:len(text) // 2 + cut] = [f"y{i}" for i in range(cut)]
        body = [f"x{rng.randrange(500)}" for _ in range(rng.randrange(300))]
        docs.append((d, " ".join(body[:len(body) // 2] + text + body[len(body) // 2:])))
        own = {tuple(made[name][i:i + 5]) for i in range(len(made[name]) - 4)}
        w = words(docs[-1][1])
        share = len(own & {tuple(w[i:i + 5]) for i in range(len(w) - 4)}) / len(own)
        if share >= ls.THRESHOLD:
            want[d, name] = share
    got = {(r.key, r.license): r.containment for r in ls.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert got == pytest.approx(want) and len(got) > 60
