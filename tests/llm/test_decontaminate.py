import random
from collections import Counter, defaultdict

import pytest

from cardloom.llm import decontaminate, templates

ITEM = "I know Tom has 5 red apples and 9 green pears in a wide basket today. Tom ate."


def test_templates(spark, odd, no_docs):
    items = spark.createDataFrame([(1, ITEM, "k"), (2, None, "k"), (3, "too short", "k"), (4, "five plain words in here", "k")], "item_id long, text string, key string")
    rows = [
        (1, "Well, Anna has 7 red apples and 12 green pears in a wide basket today"), (2, "x Anna has 7 red apples and 7 green pears in a wide basket today"),
        (3, "Tom has 5 red apples AND 9 green pears IN a wide"), (4, None), (None, ITEM), (5, "say FIVE plain, words (in) here!"), (6, "I know that red apples and green pears are in a basket"), (1, "clean"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, hash string")
    got = decontaminate.contaminated(docs, items)
    assert sorted((str(r.doc_id), r.item_id) for r in got.collect()) == [("1", 1), ("3", 1), ("5", 4), ("None", 1)]
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)[:5]) for r in left.collect()) == [("1", "clean"), ("2", "x Ann"), ("4", "None"), ("6", "I kno")]
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


# ---------------------------------------------------------------- the definition, over plain Python

W, LITERAL = decontaminate.WINDOW, decontaminate.LITERAL
ALONE = ("\u0e00", "\u0eff"), ("\u3040", "\u30ff"), ("\u3400", "\u9fff")


def raw_tokens(text):
    out, held = [], ""
    for c in text + " ":
        alone = c.isalnum() and any(a <= c <= b for a, b in ALONE)
        if c.isspace() or alone:
            out += [held] if held else []
            held = ""
        out += [c] if alone else []
        held += "" if c.isspace() or alone else c
    return out


def kinds(text):
    return [x[:3] for x in tokens_and_signs(text)]


def tokens_and_signs(text):
    """(kind, value, starts a sentence, what stands behind it without letter or digit) of each token."""
    out, starts, number_before = [], True, False
    for t in raw_tokens(text):
        core = [i for i, c in enumerate(t) if c.isalnum()]
        if not core and out:
            out[-1][3].append(t)
        if core:
            core = t[core[0] : core[-1] + 1]
            if not any(c.isalpha() for c in core) or core.lower() in templates.NUMBER_WORDS:
                kind = "number"
            elif not core[0].isalpha():
                kind = "measure"
            elif number_before and core.lower() in templates.UNITS:
                kind = "unit"
            else:
                kind = "name" if core[0].isupper() and len(core) > 1 and core.lower() not in templates.FUNCTION_WORDS else "word"
            out.append((kind, core.lower(), starts, []))
            number_before = kind == "number"
        told = t.rstrip("\"'”’»)]")
        starts = bool(told) and told[-1] in ".!?…。"
    return out


def windows(text, sizes, patterns=None):
    """(key, position, slots as {offset: value})."""
    t = tokens_and_signs(text)
    for n in sizes if sizes else [min(W, len(t))]:
        for at in range(len(t) - n + 1 if n else 0):
            some = [x[:3] for x in t[at : at + n]]
            signs = [tuple(sorted(x[3])) for x in t[at : at + n - 1]]
            plain = [k in ("number", "unit", "measure") for k, _, _ in some]
            inner = [p or (k == "name" and not s) for p, (k, _, s) in zip(plain, some, strict=True)]
            readings = [plain, inner, [p or k == "name" for p, (k, _, _) in zip(plain, some, strict=True)]]
            for slot, opening in [*((r, False) for r in readings[: 2 if sizes else 3]), (readings[2], True)]:
                if n - sum(slot) >= LITERAL:
                    yield tuple((k, opening and k == "name" and s) if x else (v,) for x, (k, v, s) in zip(slot, some, strict=True)), at, {i: v for i, (x, (_, v, _)) in enumerate(zip(slot, some, strict=True)) if x}
            for names in (patterns or {}).get(n, ()):
                if not any(plain[i] or some[i][2] for i in names) and not (all(inner[i] for i in names) and sum(inner) == sum(plain) + len(names)) and n - sum(plain) - len(names) >= LITERAL:
                    key = tuple(("name", False) if i in names else (k, False) if p else (v,) for i, (p, (k, v, _)) in enumerate(zip(plain, some, strict=True)))
                    yield key, at, {i: v for i, (p, (_, v, _)) in enumerate(zip(plain, some, strict=True)) if p or i in names}
            if n - sum(plain) < LITERAL:
                yield ("values", *(v for _, v, _ in some)), at, {}
                if n - sum(plain) + sum(map(len, signs)) >= LITERAL:
                    yield ("signs", tuple(k if p else v for p, (k, v, _) in zip(plain, some, strict=True)), tuple(signs)), at, {i: v for i, (p, (_, v, _)) in enumerate(zip(plain, some, strict=True)) if p}


def patterns_of(items):
    """Places of names inside the items' windows, by size."""
    found = defaultdict(set)
    for _, text in items:
        t = kinds(text or "")
        n = min(W, len(t))
        for at in range(len(t) - n + 1 if n else 0):
            some = t[at : at + n]
            names = frozenset(i for i, (k, _, s) in enumerate(some) if k == "name" and not s)
            if names and sum(k in ("number", "unit", "measure") for k, _, _ in some) + len(names) + LITERAL <= n:
                found[n].add(names)
    return found


def brute(docs, items):
    patterns = patterns_of(items)
    known, sizes = defaultdict(list), {min(W, len(kinds(t or ""))) for _, t in items} - {0}
    for item, text in items:
        for key, at, slots in windows(text or "", None):
            known[key].append((item, at, slots))
    found = set()
    for doc, text in docs:
        runs = defaultdict(list)
        for key, at, slots in windows(text or "", sizes, patterns):
            for item, item_at, item_slots in known[key]:
                runs[item, at - item_at].append((item_at, [(item_at + k, v, slots[k]) for k, v in item_slots.items()]))
        for (item, _), run in runs.items():
            votes = Counter((i, d) for _, i, d in {s for _, some in run for s in some})

            def best(pair, side, votes=votes):
                rivals = {p: n for p, n in votes.items() if p[side] == pair[side] and p != pair}
                return pair[0] == pair[1] or all(votes[pair] > n and p[0] != p[1] for p, n in rivals.items())

            if any(all(best((i, d), 0) and best((i, d), 1) for _, i, d in some) for _, some in run):
                found.add((doc, item))
    return found


NAMES = "Tom Anna McDonald NASA O'Brien Zoë Li".split()
FORMS = [
    "{a} has {x} red apples and {b} gives away {y} of them to the children near the river.",
    "If {a} walks {x} km in {y} hours, how far will {b} walk in the same time on the same road?",
    "A train leaves at {x} and {a} waits {y} minutes for it, says {b} to the other people there.",
    "{a} met {b}. Then {b} paid {x} dollars for the book that {a} had bought for {y} euros last week",
    "What is the capital of {a}?", "{a} has {x} apples in the basket.", "Compute {x} + {y} * {x} now.", "What is {x}+{y}?", "{a} {b} {x} {y}",
]


def filled(form, r):
    a, b = r.sample(NAMES, 2)
    x, y = r.sample(range(2, 99), 2)
    return form.format(a=a, b=b, x=x, y=y)


def test_against_brute_force(spark, docs, sf_dir):
    """Documents with copies, rephrasings and half-way changes of items, and the given ones."""
    r = random.Random(4)
    items = [(r_.item_id, r_.text) for r_ in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(1000 + k, filled(f, r)) for k, f in enumerate(FORMS * 2)] + [(2000, None), (2001, "***"), (2002, "汉字漢字"), (2003, items[0][1])]
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    for k in range(150):
        words = ["so", "Then", "we", "said:", filled(r.choice(FORMS), r), filled(r.choice(FORMS), r), "这是汉字漢字吗", "the", "end."]
        r.shuffle(words)
        text = " ".join(words)
        rows.append((10_000 + k, text.lower() if k % 7 == 0 else text.upper() if k % 11 == 0 else text.replace("7", "8") if k % 3 == 0 else text))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(rows, items)
    assert got == want
    assert len({d for d, _ in want if d < 10_000}) >= 3 and len({d for d, _ in want if d >= 10_000}) > 100


def test_rephrased_items_are_found(spark):
    """Other names and numbers: nine of ten at least, of the forms with enough words of their own."""
    r = random.Random(5)
    forms = FORMS[:4] + ["Compute {x} + {y} * 5 - 6 / 2 now.", "Solve {x}z + {y} = 20 for z."]
    items = [(k, filled(f, r)) for k, f in enumerate(forms)]
    rows = [(k, f"Some words before. {filled(forms[k % 6], r)} And after") for k in range(300)]
    rows = [(k, (str.lower, str.upper, str)[k % 3](t)) for k, t in rows]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sum(x.item_id == x.doc_id % 6 for x in got.collect()) >= 270


LONG = "on the day when 7 boats came in from sea we saw 7 men and then went home again"


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("Compute 3 + 4 * 5 - 6 / 2 now.", "x Compute 3 + 4 * 5 - 6 / 2 now. y"), ("What is 2+2?", "ask: What is 2+2? ok"), ("quick brown fox jumps over the lazy dog", "a quick brown fox jumps over the lazy dog b"),
        (LONG, LONG.replace("7 men", "8 men")), ("Compute 3 + 4 * 5 - 6 / 2 now.", "so COMPUTE 8 + 9 * 1 - 7 / 6 now ok"), ("Solve 3x + 5 = 20 for x.", "please solve 7x + 2 = 51 for x today"),
        ("Tom has 5 red apples and Anna gives away 9 of them", "then bob has 7 red apples and zoe gives away 4 of them"), ("Tom has 5 red apples and Anna gives away 9 of them", "BOB HAS 7 RED APPLES AND ZOE GIVES AWAY 4 OF THEM"),
        ("there are five red apples and nine green pears in the bowl", "there are seven red apples and twelve green pears in the bowl"), ("there are five red apples and nine green pears in the bowl", "there are 7 red apples and 12 green pears in the bowl"), ("Tom has 5 apples in the basket.", "Anna has 7 apples in the basket."),
        ("Anna met Tom and Li near Paris on a very cold day", "anna met tom and li near paris on a very cold day"), ("汉字漢字", "这是汉字漢字吗"), ("NASA and McDonald met the old man near the sea", "then O'Brien and Zoë met the old man near the sea"),
    ],
)
def test_found(spark, item, text):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, item), (3, item)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(1, text), (2, "clean")], "doc_id long, text string"), items).collect()
    assert {(1, 2), (1, 3)} <= {(x.doc_id, x.item_id) for x in got} and all(x.doc_id == 1 for x in got)


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("Compute 3 + 4 * 5 - 6 / 2 now.", "Compute 8 - 9 * 2 + 4 / 7 now."), ("Compute 3 + 4 * 5 - 6 / 2 now.", "Compute 8 9 2 4 7 now."), ("Solve 3x + 5 = 20 for x.", "Solve 7x - 2 = 51 for x."),
        ("Tom has 5 red apples and Anna gives away 9 of them", "bob has 7 red apples and 3 gives away 4 of them"), ("1 2 3 4 5 6 7 8 9", "9 8 7 6 5 4 3 2 1"),
    ],
)
def test_not_found(spark, item, text):
    """Other signs, a number where a name stands, nothing but numbers."""
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).count() == 0


def test_very_long_text_and_odd_rows(spark, odd):
    long = "w " * 300_000 + ITEM + " v" * 10
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(77, long), (78, "x" * 400_000 + " " + ITEM)], "doc_id long, text string"))
    items = spark.createDataFrame([(1, ITEM), (2, "")], "item_id long, text string")
    assert {77, 78} <= {r.doc_id for r in decontaminate.contaminated(rows, items).collect()}


def test_tokens_do_not_depend_on_where_a_text_is_cut(monkeypatch, docs):
    texts = [d.text or "" for d in docs.limit(60).collect()]
    whole = templates.tokens_of(texts)
    monkeypatch.setattr(templates, "CHUNK", 500)
    cut = templates.tokens_of(texts)
    assert all((getattr(whole, k) == getattr(cut, k)).all() for k in ("value", "kind", "initial", "text", "ends", "counts"))
    assert all((getattr(whole, k)[:-1] == getattr(cut, k)[:-1]).all() for k in ("signs", "n_signs"))


def test_kinds():
    names = {"word": templates.WORD, "number": templates.NUMBER, "name": templates.NAME, "unit": templates.UNIT, "measure": templates.MEASURE}
    text = "Tom, has 3,000 km 'in' 5kg 1st *** (20%) NASA's 2+2? Then km $5.50 dollars I é Él."
    got = templates.tokens_of([text, "", text])
    want = kinds(text)
    assert got.kind.tolist() == [names[k] for k, _, _ in want] * 2 and got.initial.tolist() == [s for _, _, s in want] * 2
    assert [k for k, _, _ in want] == ["name", "word", "number", "unit", "word", "measure", "measure", "number", "name", "number", "word", "word", "number", "unit", "word", "word", "name"]
    assert got.value[0] == templates.value_of("tom")
