"""Small messy tables of our own, with the dirt of the catalog tasks: cleaned, compared as text, graded."""

import pytest

from burnish.plans.tasks import clean_task, grade_file, grade_suite, task_specs
from burnish.sources.catalog import TASKS, available_tasks, task_catalog
from burnish.sources.tables import ORDER, read_table

PAIRS = {
    "easy": (
        "customer_id,name,email,phone\n1,Ann,ann@x.com,1\n2,Bo,,2\n1,Ann,ann@x.com,1\n",
        "customer_id,name,email,phone\n1,Ann,ann@x.com,1\n2,Bo,,2\n",
    ),
    "medium": (
        "order_id,customer_name,order_date,amount,email\n"
        "1,  JANE ROE  ,1/18/24,  $250.00  ,JANE@X.COM\n2,kim o'neil,01-20-2024,  invalid  ,kim@example\n"
        '3,"lee\nann",2024/01/21,200,lee@x.com\n4,Max,22-01-2024,3.5,\n',
        "order_id,customer_name,order_date,amount,email\n"
        "1,Jane Roe,2024-01-18,250.00,jane@x.com\n2,Kim O'Neil,2024-01-20,0.00,kim@example.com\n"
        '3,"Lee\nAnn",2024-01-21,200.00,lee@x.com\n4,Max,2024-01-22,3.50,unknown@example.com\n',
    ),
    "hard": (
        "product_id,name,category,price,quantity,last_updated,supplier\n"
        'P001,usb-c 10ft,ELECTRONICS,12.50 USD,-5,2024-01-17, Acme \n,Monitor 27",storage,$9,,invalid,B\n'
        "P003,mouse,accessories,USD 3,4,3/2/2024,C\n",
        "product_id,name,category,price,quantity,last_updated,supplier\n"
        'P001,Usb-C 10Ft,Electronics,12.50,0,2024-01-17,Acme\nP002,"Monitor 27""",Storage,9.00,0,2024-01-01,B\n'
        "P003,Mouse,Accessories,3.00,4,2024-03-02,C\n",
    ),
    "hr": (
        "employee_id,name,department,salary,hire_date,city,email\n"
        "E1,ivy white,it,$50000,2020-01-02,new york,ivy@company.com\nE2,Al Po,SALES,USD 700,2020-01-03,,ivy.whitecompany.com\n"
        "E1,IVY WHITE,IT,1,2020-01-02,x,y\nE3,B C,hr,,5/6/2021,Paris,b@company\n",
        "employee_id,name,department,salary,hire_date,city,email\n"
        "E1,Ivy White,IT,50000,2020-01-02,New York,ivy@company.com\nE2,Al Po,Sales,700,2020-01-03,,ivy.white@company.com\n"
        "E3,B C,HR,0,2021-05-06,Paris,b@company.com\n",
    ),
    "logistics": (
        "tracking_id,origin,destination,carrier,weight_kg,ship_date,status\n"
        "T1,los angeles,TOKYO,fedex,12,2024-05-06,Delivered\nT1,Los Angeles,Tokyo,FedEx,12.0,2024-05-06,delivered\n",
        "tracking_id,origin,destination,carrier,weight_kg,ship_date,status\n"
        "T1,Los Angeles,Tokyo,FedEx,12.0,2024-05-06,delivered\n",
    ),
}


@pytest.fixture
def folder(tmp_path):
    for name, (messy, clean) in PAIRS.items():
        (tmp_path / f"{name}_messy.csv").write_text(messy, encoding="utf-8")
        (tmp_path / f"{name}_clean.csv").write_text(clean, encoding="utf-8")
    return tmp_path


def test_cleaned_text(spark, folder):
    specs, tasks = task_specs(), available_tasks(spark, str(folder))
    assert [t.name for t in tasks] == ["easy", "medium", "hard", "hr", "logistics"]
    for task in tasks:
        cleaned = clean_task(spark, str(folder), task, specs[task.name]).drop(ORDER)
        truth = read_table(spark, f"{folder}/{task.clean_file}")
        blank = lambda rows: sorted(tuple(c or "" for c in r) for r in rows.collect())
        assert blank(cleaned) == blank(truth), task.name


def test_grades(spark, folder):
    before = {r.task: r.reward for r in grade_suite(spark, str(folder)).collect()}
    after = {r.task: r.reward for r in grade_suite(spark, str(folder), clean=True).collect()}
    assert set(after) == set(PAIRS) and all(v == pytest.approx(0.99) for v in after.values())
    assert all(before[name] < after[name] for name in ("medium", "hard", "hr", "logistics"))


def test_a_broken_submission_scores_lower(spark, folder):
    """A table whose quoted line break has been cut is not the table any more."""
    whole, cut = f"{folder}/medium_clean.csv", folder / "cut.csv"
    cut.write_text(PAIRS["medium"][1].replace('"Lee\nAnn"', "Lee\nAnn"), encoding="utf-8")
    assert grade_file(spark, whole, whole).first().reward == pytest.approx(0.99)
    assert grade_file(spark, str(cut), whole).first().reward < 0.95
    assert grade_file(spark, None, whole).first().reward == grade_file(spark, f"{folder}/none.csv", whole).first().reward == 0.01


def test_catalog(spark, folder):
    decoy = folder / "old" / folder.name
    decoy.mkdir(parents=True)
    for side in ("messy", "clean"):
        (decoy / f"finance_{side}.csv").write_text("a\n1\n")
    (folder / "education_messy.csv").write_text("a\n1\n")
    assert [r.task for r in task_catalog(spark, str(folder)).collect()] == ["easy", "medium", "hard", "hr", "logistics"]
    missing = task_catalog(spark, f"{folder}/missing").collect()
    assert [r.task for r in missing] == [t.name for t in TASKS if t.always]
