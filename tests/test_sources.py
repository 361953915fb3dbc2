import pytest

from plumbrow.sources import files, shared


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_raw_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Patient Name, Age ,Note\n"Smith, ""Jo""",42,\nLee,-1,x\n', "utf-8-sig")
    df = files.read_raw_csv(spark, path)
    assert df.dtypes == [("patient_name", "string"), ("age", "string"), ("note", "string")]
    assert [tuple(r) for r in df.collect()] == [('Smith, "Jo"', "42", None), ("Lee", "-1", "x")]


def test_a_row_of_the_wrong_width_fails(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_raw_csv(spark, path).collect()


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n"x\ny",2\n')
    assert [tuple(r) for r in files.read_raw_csv(spark, path, multiline=True).collect()] == [("x\ny", "2")]


def test_several_files(spark, tmp_path):
    a = write(tmp_path / "a.csv", " x ,y\n" + "".join(f"a{i},{i}\n" for i in range(50)))
    b = write(tmp_path / "b.csv", "other,names\n" + "".join(f"b{i},{i}\n" for i in range(5)))
    c = write(tmp_path / "c.csv", "x,y,z\n1,2,3\n")
    d = write(tmp_path / "d.csv", " x ,y\nd,1\n")
    found = files.read_csv_files(spark, [a, b, c, d])
    assert found.rows.columns == ["x", "y"]
    assert sorted(r[0] for r in found.rows.collect()) == sorted([f"a{i}" for i in range(50)] + [f"b{i}" for i in range(5)] + ["d"])
    assert [tuple(r) for r in found.left_out.collect()] == [(c, 3)]


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    paths = [write(tmp_path / f"a {i}%.csv", f"x,y\n{i},1\n") for i in range(150)]
    paths += [write(tmp_path / f"b{i}.csv", f"y,x\n{i},2\n") for i in range(50)]
    paths += [write(tmp_path / f"c{i}.csv", "one\n1\n") for i in range(30)]
    spark.sparkContext.setJobGroup("headers", "headers")
    found = files.read_csv_files(spark, paths)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10  # listings, one job for all files, and one for each of the three headers
    assert sorted(tuple(map(int, r)) for r in found.rows.collect()) == sorted([(i, 1) for i in range(150)] + [(i, 2) for i in range(50)])
    assert sorted(tuple(r) for r in found.left_out.collect()) == sorted((p, 1) for p in paths[200:])


def test_headers_of_large_files_folders_and_repeated_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SMALL", 30)
    large = write(tmp_path / "large.csv", "x,y\n" + "1,2\n" * 50)
    small = write(tmp_path / "small.csv", "x,y\n3,4\n")
    folder = str(tmp_path / "folder")
    spark.createDataFrame([("5", "6")], "x string, y string").write.option("header", True).csv(folder)
    found = files.read_csv_files(spark, [large, small, folder, small, write(tmp_path / "empty.csv", "")])
    assert sorted(tuple(r) for r in found.rows.collect()) == [("1", "2")] * 50 + [("3", "4")] * 2 + [("5", "6")]
    assert [r.columns for r in found.left_out.collect()] == [0]


def test_headers_with_line_breaks(spark, tmp_path):
    a = write(tmp_path / "a.csv", 'x,"y\n1"\n1,2\n')
    b = write(tmp_path / "b.csv", 'x,"y\n1",z\n1,2,3\n')
    found = files.read_csv_files(spark, [a, b], multiline=True)
    assert found.rows.columns == ["x", "y\n1"] and found.rows.count() == 1
    assert [tuple(r) for r in found.left_out.collect()] == [(b, 3)]


def test_materialize_replaces(spark, tmp_path):
    path = str(tmp_path / "stage")
    files.materialize(spark.range(10), path)
    out = files.materialize(spark.range(3), path, view="stage_view")
    assert out.count() == spark.table("stage_view").count() == 3


def test_a_broken_write_leaves_the_stage_before(spark, tmp_path):
    path = str(tmp_path / "stage")
    with pytest.raises(FileNotFoundError):
        files.read_stage(spark, path)
    before = files.materialize(spark.range(10), path)
    failing = spark.range(100).selectExpr("CASE WHEN id < 90 THEN id ELSE raise_error('broken off') END AS id").repartition(8)
    with pytest.raises(Exception, match="broken off"):
        files.materialize(failing, path)
    assert files.read_stage(spark, path).count() == before.count() == 10
    # The next stage may read the one it replaces, whose readers go on; what the broken write left goes.
    after = files.materialize(files.read_stage(spark, path).filter("id < 4"), path)
    assert files.read_stage(spark, path).count() == after.count() == 4 and before.count() == 10
    assert sum(f.name.startswith("version-") for f in (tmp_path / "stage").iterdir()) == 2
    files.materialize(spark.range(1), path)
    assert files.read_stage(spark, path).count() == 1 and sum(f.is_dir() for f in (tmp_path / "stage").iterdir()) == 2


def test_tables_by_format(spark, tmp_path):
    spark.range(4).write.orc(str(tmp_path / "t.orc"))
    assert files.read_tables(spark, str(tmp_path), ["t"], "orc")["t"].count() == 4


def test_shared_folder_is_the_one_the_session_names(spark, tmp_path):
    df = shared.cut(spark.range(5), "step", folder=str(tmp_path))
    assert df.count() == 5 and all(str(tmp_path) in f for f in df.inputFiles())
    assert shared.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    shared.clear(spark, str(tmp_path))
    assert not list(tmp_path.iterdir())
