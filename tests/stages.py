"""What the stages of a session have shuffled, for tests of how work grows."""


def shuffled_rows(spark) -> dict:
    """Rows that each stage so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, getattr(store, "stageList$default$4")(), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}


def rows_since(spark, before: dict) -> int:
    return sum(n for key, n in shuffled_rows(spark).items() if key not in before)
