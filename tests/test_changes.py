import random

from skimlight.operators import changes as C
from skimlight.operators.ranking import blend, top

SCHEMA = "seq long, docid string, deleted boolean, ts int, fields map<string,string>, variables map<int,double>, categories map<string,string>"


def replay(rows):
    state = {}
    for seq, docid, deleted, ts, fields, variables, categories in sorted(rows, key=lambda r: r[0]):
        s = state.setdefault(docid, {})
        s["deleted"] = deleted
        if deleted:
            s |= {"ts": None, "fields": None, "variables": None, "categories": None}
            continue
        s["ts"] = ts if ts is not None else s.get("ts")
        s["fields"] = fields if fields is not None else s.get("fields")
        for name, value in (("variables", variables), ("categories", categories)):
            if value is not None:
                s[name] = (s.get(name) or {}) | value
    return state


def random_log(rng, n):
    rows = []
    for seq in range(n):
        deleted = rng.random() < 0.15
        rows.append((
            seq, f"d{rng.randrange(8)}", deleted, None if deleted or rng.random() < 0.5 else seq,
            None if deleted or rng.random() < 0.6 else {"text": f"t{seq}"},
            None if deleted or rng.random() < 0.5 else {rng.randrange(3): float(seq)},
            None if deleted or rng.random() < 0.5 else {rng.choice("ab"): rng.choice(["x", "y"])},
        ))
    return rows


def as_dict(df):
    return {r.docid: {k: r[k] for k in ("deleted", "ts", "fields", "variables", "categories")} for r in df.collect()}


def test_fold_equals_replay(spark):
    rng = random.Random(2)
    for n in (0, 1, 60, 200):
        rows = random_log(rng, n)
        want = {d: {k: s.get(k) or (s.get(k) if k == "ts" else None) or (False if k == "deleted" else None) for k in ("deleted", "ts", "fields", "variables", "categories")} for d, s in replay(rows).items()}
        assert as_dict(C.fold(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_compaction_equals_fold(spark):
    rng = random.Random(9)
    rows = random_log(rng, 150)
    old, new = (spark.createDataFrame([r for r in rows if (r[0] < 80) == first], SCHEMA) for first in (True, False))
    whole = {d: s for d, s in as_dict(C.fold(spark.createDataFrame(rows, SCHEMA))).items() if not s["deleted"]}
    assert as_dict(C.compact(C.fold(old), new)) == whole


def test_empty_category_is_removed(spark):
    rows = [(0, "d", False, 1, {"text": "a"}, None, {"c": "x", "e": "y"}), (1, "d", False, None, None, None, {"c": ""})]
    assert C.fold(spark.createDataFrame(rows, SCHEMA)).first().categories == {"e": "y"}


def test_blend(spark):
    def df(scores):
        return spark.createDataFrame(list(scores.items()), "docid string, score double")

    old, fresh = df({"1": 1.0, "3": 0.8, "6": 0.5}), df({"2": 0.9, "4": 0.7, "5": 0.6})
    assert [r.docid for r in top(blend(old, fresh, fresh)).collect()] == list("123456")
    assert [tuple(r) for r in top(blend(df({"1": 1.0}), df({"1": 0.7}), df({"1": 0.7}))).collect()] == [("1", 0.7)]
    assert [r.docid for r in top(df({"a": float("nan"), "b": 2.0, "c": float("inf")})).collect()] == ["a", "c", "b"]
