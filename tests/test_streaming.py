from tidewise.operators.clean import Cleaner
from tidewise.operators.features import fit_feature_table
from tidewise.session import checkpoint_dir
from tidewise.streaming.apply import apply_models, read_stream, write_stream


def test_fitted_models_apply_to_a_stream(spark, dirty):
    model = Cleaner().fit(dirty)
    clean = model.transform(dirty)
    ftm = fit_feature_table(clean)
    src = f"{checkpoint_dir(spark)}/stream-src"
    dirty.write.mode("overwrite").parquet(src)
    stream = read_stream(spark, src, dirty.schema)
    out = apply_models(stream, model, ftm)
    q = write_stream(out, None, "tw_stream_test", fmt="memory")
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM tw_stream_test")
    batch = ftm.transform(clean)
    assert sorted(got.columns) == sorted(batch.columns)
    assert got.count() == batch.count()
