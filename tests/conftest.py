import pytest

from quillmere.session import local_session, share


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    share(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lexicon(spark):
    rows = [("黄芪", "herb"), ("黄芪汤", "formula"), ("甘草", "herb"), ("桂枝", "herb"), ("发热", "symptom"), ("恶寒", "symptom"), ("口渴", "symptom"), ("气虚证", "pattern"), ("感冒", "disease"), ("感冒", "western_disease"), ("脉", "other")]
    return spark.createDataFrame([(t, k, 1.0, 0) for t, k in rows], "term string, type string, weight double, priority int")
