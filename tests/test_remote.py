import pytest

from loomspan import session
from loomspan.sources.remote import filesystem


def test_schemes(tmp_path):
    for uri in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        assert filesystem(uri)[1] == str(tmp_path)
    fs, path = filesystem("s3a://place/a/b?region=us-east-1")
    assert fs.type_name == "s3" and path == "place/a/b"


@pytest.mark.parametrize("default", ["file:///", "hdfs://127.0.0.1:8020"])
def test_a_folder_without_scheme_lies_in_the_default_file_system(spark, default):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", default)
    try:
        want = "file:///user/x/chk" if default.startswith("file") else "hdfs://127.0.0.1:8020/user/x/chk"
        assert session.qualified(spark, "/user/x/chk") == want
        assert session.qualified(spark, "file:/a/b") == "file:///a/b" and session.qualified(spark, "file:///a/b") == "file:///a/b"
    finally:
        conf.set("fs.defaultFS", before)
