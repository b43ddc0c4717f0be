"""Layer 3: rule replays on published result rows (selection, warm-up sizes,
deltas) and the parsing rules."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import select
from canopy.plans.study import PHASE1_PERCENTAGES, phase1_trees

# Published grid rows of one dataset (Auto MPG): approach, depth, cv, test, trees, phase-1 trees, pct, chosen
PUBLISHED = [
    ("baseline", 1, 0.08639480071935905, 0.08016038014497565, 214, None, None, False),
    ("baseline", 2, 0.08322877358956983, 0.07972172945127241, 113, None, None, False),
    ("baseline", 3, 0.08241886547897065, 0.08015748097594443, 105, None, None, False),
    ("baseline", 4, 0.08117526397340133, 0.08499266692098195, 97, None, None, True),
    ("baseline", 5, 0.08147867234519598, 0.09309281584871665, 107, None, None, False),
    ("baseline", 6, 0.08213943434522751, 0.09510313354883801, 106, None, None, False),
    ("baseline", 7, 0.0843246261643884, 0.093324609817971, 212, None, None, False),
    ("baseline", 8, 0.08409152918789212, 0.09082826084539314, 155, None, None, False),
    ("baseline", 9, 0.08465682464991267, 0.09044982061396727, 178, None, None, False),
    ("baseline", 10, 0.08305374546490958, 0.08903919838464551, 272, None, None, False),
    ("monotonic", 1, 0.08599611601389405, 0.07704072094552919, 264, None, None, False),
    ("monotonic", 2, 0.08336953252834159, 0.07602047724025293, 181, None, None, False),
    ("monotonic", 3, 0.08192987589939564, 0.07847884472256278, 174, None, None, False),
    ("monotonic", 4, 0.07987029282708337, 0.08542003048907779, 129, None, None, True),
    ("monotonic", 5, 0.0808437521393061, 0.08728288382674328, 115, None, None, False),
    ("monotonic", 6, 0.08213701472172212, 0.09042944723477805, 110, None, None, False),
    ("monotonic", 7, 0.08412477037871438, 0.0918640507460523, 121, None, None, False),
    ("monotonic", 8, 0.08466195800920825, 0.09097995249188158, 129, None, None, False),
    ("monotonic", 9, 0.08456331598211016, 0.09021359404249676, 120, None, None, False),
    ("monotonic", 10, 0.08461766099114343, 0.09063412189850455, 124, None, None, False),
    ("progressive", 4, 0.07993194135741913, 0.08075968649789271, 159, 5, 0.025, False),
    ("progressive", 4, 0.08003264815139666, 0.08166648472693042, 158, 6, 0.05, False),
    ("progressive", 4, 0.07958333638275188, 0.08252583914461645, 104, 9, 0.075, True),
    ("progressive", 4, 0.08038731325032547, 0.08440656155190125, 124, 12, 0.1, False),
    ("progressive", 4, 0.08066341430135278, 0.08298045724165391, 184, 16, 0.125, False),
    ("progressive", 4, 0.08104367982996322, 0.08485023855216975, 223, 19, 0.15, False),
    ("progressive", 4, 0.08193914032439178, 0.0846568134583434, 190, 22, 0.175, False),
    ("progressive", 4, 0.0816682458465596, 0.08583895654504577, 175, 25, 0.2, False),
]


@pytest.fixture()
def published(spark):
    rows = [("auto_mpg", a, d, cv, te, n, p1, pct, False, i)
            for i, (a, d, cv, te, n, p1, pct, _) in enumerate(PUBLISHED)]
    return spark.createDataFrame(rows, select.RESULT_SCHEMA)


def test_choose_best_replays_published_flags(published):
    got = {r["run_ix"] for r in select.choose_best(published).where("chosen").collect()}
    want = {i for i, r in enumerate(PUBLISHED) if r[7]}
    assert got == want


def test_warmup_sizes_replay(published):
    best = select.best_of(published, "monotonic").first()
    assert (best["max_depth"], best["n_trees"]) == (4, 129)
    sizes = [phase1_trees(best["n_trees"], p) for p in PHASE1_PERCENTAGES]
    assert sizes == [r[5] for r in PUBLISHED if r[0] == "progressive"]


def test_warmup_size_column(spark):
    from canopy.functions.scalar import warmup_trees
    df = spark.createDataFrame([(129, p) for p in PHASE1_PERCENTAGES], "n int, p double")
    assert [r[0] for r in df.select(warmup_trees("n", "p")).collect()] == [5, 6, 9, 12, 16, 19, 22, 25]


def test_deltas(published):
    d = {r["approach"]: r for r in select.deltas(select.choose_best(published)).collect()}
    assert d["monotonic"]["delta"] == pytest.approx(0.08542003048907779 - 0.08499266692098195)
    assert d["progressive"]["delta_text"] == "%+.1f%%" % (
        100 * (0.08252583914461645 - 0.08499266692098195) / 0.08499266692098195)


def test_constraint_parsing(spark):
    from canopy.functions.scalar import constraint_direction, constraint_feature, split_list
    df = spark.createDataFrame([(" weight:-1 ; a:b:+1;; age ;weight:1",)], "s string")
    items = df.select(F.explode(split_list("s")).alias("i"))
    got = [(r[0], r[1]) for r in items.select(constraint_feature("i"), constraint_direction("i")).collect()]
    assert got == [("weight", -1), ("a:b", 1), ("age", 1), ("weight", 1)]
    bad = spark.createDataFrame([("x:2",)], "i string")
    with pytest.raises(Exception):
        bad.select(constraint_direction("i")).collect()


def test_config_scan(spark, tmp_path):
    from canopy.sources.text import read_config
    p = tmp_path / "cfg.csv"
    p.write_text('dataset,target,monotonic,objective,lr\n'
                 'data/a.csv,y,"f:+1; g:-1 ;f:-1",,\n'
                 'data/b.csv,"Strength (MPa) ",,reg:gamma,0.02\n')
    rows = read_config(spark, str(p)).orderBy("name").collect()
    assert rows[0]["name"] == "a" and rows[0]["monotonic"] == {"f": -1, "g": -1}
    assert rows[0]["objective"] == "count:poisson" and rows[0]["lr"] == 0.1
    assert rows[1]["target"] == "Strength (MPa) " and rows[1]["monotonic"] == {}


def test_whitespace_scan(spark, tmp_path):
    from canopy.sources.text import read_whitespace
    p = tmp_path / "mpg.data"
    p.write_text('18.0   8   307.0      130.0      3504.      12.0   70  1\t"chevrolet chevelle malibu"\n'
                 '25.0   4   98.00      ?          2046.      19.0   71  1\t"ford pinto"\n')
    rows = read_whitespace(spark, str(p)).collect()
    assert rows[0]["car_name"] == "chevrolet chevelle malibu" and rows[0]["cylinders"] == 8
    assert rows[1]["horsepower"] == "?"


def test_file_stem(spark):
    from canopy.functions.scalar import file_stem
    df = spark.createDataFrame([("data_processed/ames_housing.csv",), ("a/b/c.tar.gz",),
                                ("x/.hidden",), ("dir/",)], "p string")
    assert [r[0] for r in df.select(file_stem("p")).collect()] == ["ames_housing", "c.tar", ".hidden", "dir"]
