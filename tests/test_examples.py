import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(name):
    spec = importlib.util.spec_from_file_location(name, f"{ROOT}/examples/{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_demo(spark, tmp_path):
    answers = load("demo").run(spark, str(tmp_path))
    assert all(r.get("status") != "error" for _, responses in answers for r in responses)
    found = [[r["_id"] for r in responses[:-1]] for request, responses in answers if request["command"] == "find_documents"]
    assert found == [["lamp", "shelf"], ["rug", "sofa"], ["rug", "sofa"], ["rug"], ["shelf", "sofa"], ["sofa", "rug", "shelf", "lamp"]]


def test_load(spark, tmp_path):
    took = load("load").run(spark, str(tmp_path), 12, 3)
    assert sum(map(len, took.values())) == 12
