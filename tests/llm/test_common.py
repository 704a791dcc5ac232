import pytest

from ledgerlens import staging
from ledgerlens.llm import common, secrets

SCHEMA = "doc_id long, text string, source string, lang string"


def test_a_run_deletes_its_own_tables_only(spark):
    early = secrets.scan(spark.createDataFrame([(1, "token=abcdefghij", "o", "en")], SCHEMA))
    with common.scratch_run(spark):
        inside = common.written(spark.range(3), "inside")
        assert inside.count() == 3
        with common.scratch_run(spark):
            common.written(spark.range(2), "inner")
        assert inside.count() == 3
    with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
        inside.count()
    assert early.first().spans[0].kind == "assign"


def test_settings_come_back(spark):
    key = common.ROWS_KEY
    before = spark.conf.get(key)
    with common.setting(spark, key, "7"):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
    with common.setting(spark, key, "9"):
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "9"  # a lower limit is left alone


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class C:
                    @staticmethod
                    def getCheckpointDir():
                        return Empty()

                return C

    class Session:
        conf, sparkContext = Conf(), Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session)
