"""The minutes parser against a plain line-by-line version on random documents."""

import random
import re

import pytest

from rostrum.operators import minutes as M

LINES = [
    "C1 FIRST ITEM", "C-2 Second item", "R 03 THIRD", "C1 SECOND ROW OF C1", "C2 and the rest of a wrapped list", "Recommendation: approve", "Memo 12", "Approved the item.", "Approved to continue the item",
    "Denied the petition (0:15)", "Denied it. (1:02:03)", "approved in lower case.", "and so on", "until the end.", "Page 3 of 17", "3 of 17", "", "  Adopted   with    blanks.", "Approved the Consent Agenda with the exception of C1 and",
    "C2 which were withdrawn.", "Approved to receive and file documents submitted by staff.", "No action was taken.", "(0:10)", "Withdrawn at the request of C9.", "Élan vital", "Approved the withdrawal of R3.",
]
ITEMS = [(10, 1, "C1", "Consent", "first item of all"), (11, 2, "C1", "Regular", "Second row of C1"), (12, 3, "C2", "Consent", "x"), (13, 4, "R3", "Regular", "third"), (14, 5, "P4", "Public Hearings", "y")]


def parse(text):
    """(item number or None, code, heading, sentence) in order."""
    out, items, code, heading, after, held, target = [], 0, None, None, False, [], None
    lines = [re.sub(r"\s{2,}", " ", x).strip(" ") for x in re.split(r"\r\n|\r|\n", text or "")]
    for x in [x for x in lines if x and not re.search(M.FURNITURE, x)] + [None]:
        if held:
            ended = re.sub(M.OFFSET, "", " ".join(held).rstrip(" ")).endswith(".")
            if x is not None and not ended and len(held) < M.MOST_LINES and not re.search(M.FIELD, x) and not re.search(M.HEADING, x):
                held.append(x)
                continue
            out.append((target, code if target else None, heading if target else None, " ".join(held)))
            held = []
        if x is None:
            break
        item = re.search(M.ITEM, x)
        if item:
            items, code, heading, after = items + 1, f"{item[1]}{int(item[2])}", item[3], False
        elif re.search(M.FIELD, x):
            after = True
        elif re.search(M.VERB, x) and x[0].isupper():
            held = [x]
            target = items if after and not any(re.search(p, x) for _, p in M.SECTIONS) else None
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    return [(i, rng.choice(["\n", "\r\n"]).join(rng.choices(LINES, k=rng.randrange(0, 40)))) for i in range(150)] + [(900, None), (901, "Approved\n" + "\n".join(["more"] * 20) + "\nAdopted it.")]


@pytest.fixture(scope="module")
def found(spark, texts):
    return M.sentences(spark.createDataFrame(texts, "id long, text string").repartition(3)).cache()


def test_sentences(found, texts):
    got = {}
    for r in found.orderBy("id", "no").collect():
        got.setdefault(r.id, []).append((r.item, r.code, r.heading, r.sentence))
    want = {i: parse(t) for i, t in texts}
    assert got == {i: s for i, s in want.items() if s}
    assert sum(map(len, got.values())) > 300
    assert got[901] == [(None, None, None, "Approved" + " more" * 7), (None, None, None, "Adopted it.")]


def outcome(s):
    from rostrum.functions.text import OUTCOME_RULES

    return next((n for n, p in OUTCOME_RULES if re.search(p, s)), "other") if s.strip() else None


def codes(s):
    return [re.sub(r"[^A-Z]", "", c) + str(int(re.sub(r"\D", "", c))) for c in re.findall(M.CODE, s)]


def subsidiary(s):
    return any(re.search(p, s) for p in M.SUBSIDIARY)


def decide(sentences):
    """item_id: (sentence, outcome) by occurrences in order."""
    published, out, by_item = {c for _, _, c, *_ in ITEMS}, {}, {}
    for item, code, heading, s in sentences:
        if item:
            by_item.setdefault((item, code, heading), []).append(s)
    for (_, code, heading), own in by_item.items():
        own = [s for s in own if not subsidiary(s)]
        if not own:
            continue
        about = [s for s in own if code in codes(s) or not published & set(codes(s))] or own
        refused = [s for s in about if outcome(s) in ("denied", "withdrawn")]
        s = (refused or about)[-1]
        rows = [x for x in ITEMS if x[2] == code]
        words = lambda t: re.findall(r"[^\W_]+", t.lower())

        def agree(row, heading=heading):
            n = 0
            for a, b in zip(words(heading), words(row[4]), strict=False):
                if a != b:
                    break
                n += 1
            return n

        if not rows:
            continue
        best = sorted(rows, key=lambda r: (-agree(r), r[1]))
        sure = len(rows) > 1 and agree(best[0]) >= 2 and agree(best[0]) > agree(best[1])
        out[(best if sure else rows)[0][0]] = (s, outcome(s))
    return out


def test_chosen(spark, found, texts):
    rows = [(i, *x) for i, _ in texts for x in ITEMS]
    items = spark.createDataFrame(rows, "id long, item_id long, seq int, code string, section string, title string")
    got = {(r.id, r.item_id): (r.sentence, r.outcome) for r in M.chosen(found, items).collect()}
    want = {(i, k): v for i, t in texts for k, v in decide(parse(t)).items()}
    assert got == want
    assert {k for _, k in got} >= {10, 11, 12, 13}


@pytest.mark.parametrize(
    "sentences, want",
    [
        (["Approved the Consent Agenda."], {10: ("approved", "consent"), 12: ("approved", "consent")}),
        (["Approved the Consent Agenda with the exception of C-2 which was withdrawn."], {10: ("approved", "consent"), 12: ("withdrawn", "exception")}),
        (["Approved the Consent Agenda except C2 which was pulled for discussion and noted."], {10: ("approved", "consent")}),
        (["Approved the Consent Agenda except C1 which were continued and Agenda Item C 02 which were denied."], {10: ("continued", "exception"), 12: ("denied", "exception")}),
        (["Approved the Consent Agenda which included C2 and R3."], {12: ("approved", "included")}),
        (["Approved to hear the emergency Addendum to the Consent Agenda."], {}),
        (["Approved the Rezoning Consent.", "Denied the Public Hearing Consent."], {14: ("approved", "consent")}),
        (["Approved the Consent Agenda except R3 which was withdrawn."], {10: ("approved", "consent"), 12: ("approved", "consent"), 13: ("withdrawn", "exception")}),
        (["Approved the minutes."], {}),
    ],
)
def test_disposed(spark, sentences, want):
    bulk = spark.createDataFrame([(1, n, s) for n, s in enumerate(sentences)], "id long, no int, sentence string")
    items = spark.createDataFrame([(1, *x) for x in ITEMS], "id long, item_id long, seq int, code string, section string, title string")
    assert {r.item_id: (r.outcome, r.source) for r in M.disposed(bulk, items).collect()} == want


def test_sentences_of_odd_lines(spark):
    texts = [
        (1, "C1 RING\rRecommendation: x\r\nApproved it\n(12:30)\nin full.\n(0:15)\nDenied  the\u2028rest.  (1:02:03)\nno part"),
        (1, "AB 007 Bolt\nFiscal Impact\n" + "Adopted\nline\n" * 6 + "3 of 17\nP2 Next"),
        (2, None),
        (3, "denied\nAPPROVED Consent Agenda"),
    ]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = M.sentences(docs)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # not a lambda that is interpreted for each line
    one = [(1, 0, 1, "C1", "RING", "Approved it (12:30) in full."), (1, 1, 1, "C1", "RING", "Denied the\u2028rest. (1:02:03)")]
    two = [(1, 0, 1, "AB7", "Bolt", " ".join(["Adopted line"] * 4)), (1, 1, 1, "AB7", "Bolt", "Adopted line Adopted line")]
    assert sorted(tuple(r) for r in got.collect()) == sorted([*one, *two, (3, 0, None, None, None, "APPROVED Consent Agenda")])


def test_disposed_folds_once(spark):
    docs = spark.createDataFrame([(1, "Approved the Consent Agenda with the exception of C-1, which was denied.")], "id long, text string")
    items = spark.createDataFrame([(1, 10, 1, "C1", "Consent", "a"), (1, 11, 2, "C1", "Consent", "b"), (1, 12, 3, "C2", "Consent", "c"), (1, 13, 4, "P3", "Regular", "d")], "id long, item_id long, seq int, code string, section string, title string")
    got = M.disposed(M.sentences(docs), items)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, "denied", "exception"), (1, 12, "approved", "consent")]
