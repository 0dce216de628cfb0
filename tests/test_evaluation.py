from tidewise.operators.evaluate import class_report, confusion, evaluate


def _df(spark, labels, preds):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(labels, preds)],
                                 "label double, prediction double")


def test_perfect(spark):
    m = evaluate(_df(spark, [0, 0, 1, 1, 0, 1], [0, 0, 1, 1, 0, 1])).first()
    assert m["accuracy"] == 1.0 and m["f1"] == 1.0


def test_one_class_f1_zero(spark):
    m = evaluate(_df(spark, [0, 0, 0, 0], [0, 0, 0, 0])).first()
    assert m["accuracy"] == 1.0 and m["f1"] == 0.0 and m["precision"] == 0.0


def test_rounding(spark):
    m = evaluate(_df(spark, [1, 1, 1, 0, 0, 0, 1], [1, 0, 0, 0, 1, 0, 1])).first()
    assert m["accuracy"] == round(4 / 7, 4) and m["precision"] == round(2 / 3, 4)


def test_confusion_has_zeros(spark):
    cm = {(r["label"], r["prediction"]): r["n"] for r in confusion(_df(spark, [0, 0, 1], [0, 0, 0])).collect()}
    assert cm == {(0.0, 0.0): 2, (0.0, 1.0): 0, (1.0, 0.0): 1, (1.0, 1.0): 0}


def test_class_report_against_sklearn_formulas(spark):
    rep = {r["class"]: r for r in class_report(_df(spark, [0, 0, 1, 1, 1], [0, 1, 1, 1, 0])).collect()}
    assert rep["1.0"]["precision"] == round(2 / 3, 4) and rep["1.0"]["support"] == 3
    assert rep["accuracy"]["f1"] == 0.6
    assert rep["macro avg"]["recall"] == round((0.5 + 2 / 3) / 2, 4)
