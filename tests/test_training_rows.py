"""The rows that models are trained on are joined once, whatever reads them afterwards."""

from furlong.verify import modelling
from furlong.verify.base import runners


def test_training_rows_are_written_once(spark, small):
    df = modelling._training(spark, small)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    keys = ["race_id", "runner_no", "horse_id", "jockey_id", "price", "distance", "venue"]
    want = runners(spark, small).select(*keys)
    assert df.count() == want.count()
    assert df.select(*keys).exceptAll(want).isEmpty() and want.exceptAll(df.select(*keys)).isEmpty()
