"""The text profile run as a stream equals the batch result."""


from gridwork.sources import Tables
from gridwork.streaming import read_stream, run_available_now, text_profile_stream
from tests.conftest import SF_SMALL


def test_stream_profile_matches_batch(spark, tmp_path):
    src = f"{SF_SMALL}/documents.parquet"
    out = str(tmp_path / "profile")
    run_available_now(text_profile_stream(read_stream(spark, src)), out, str(tmp_path / "progress"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    exp = sorted(tuple(r) for r in text_profile_stream(Tables(spark, SF_SMALL).documents).collect())
    assert got == exp and len(got) == 200
