"""Routes and commands over a small store."""

import io
import json

import pytest

from palimpsest import api
from palimpsest.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Store(spark, f"{tmp_path_factory.mktemp('api')}/s")


def post(store, path, **body):
    return api.route(store, "POST", path, json.dumps(body))


def test_routes(store):
    row = {"thread_id": "t", "checkpoint_id": "a", "checkpoint_no": 1, "parent_checkpoint_id": None, "messages": [{"role": "user"}]}
    assert api.route(store, "GET", "/api/health")[0] == 200
    assert post(store, "/api/checkpoints", **row)[0] == 201
    assert post(store, "/api/checkpoints", **row)[0] == 409
    assert post(store, "/api/checkpoints", **row | {"checkpoint_id": "b", "parent_checkpoint_id": "no"})[0] == 400
    assert post(store, "/api/checkpoints", **row | {"other": 1})[0] == 400
    assert post(store, "/api/checkpoints", **row | {"thread_id": ""})[0] == 400
    assert post(store, "/api/read", thread_id="t", checkpoint_id="a") == (200, '{"messages":[{"role":"user"}]}')
    assert post(store, "/api/read", thread_id="t", checkpoint_id="zz")[0] == 404
    assert api.route(store, "POST", "/api/read", "{")[0] == 400 and api.route(store, "POST", "/api/read", " " * (api.MAX_BODY + 1))[0] == 413
    assert api.route(store, "GET", "/none")[0] == 404
    assert json.loads(api.route(store, "GET", "/api/checkpoints?limit=1")[1])[0]["checkpoint_id"] == "a"
    assert post(store, "/api/delete", thread_id="t", checkpoint_id="a", confirm="yes")[0] == 400
    assert json.loads(post(store, "/api/delete", thread_id="t", checkpoint_id="a", confirm="delete-subtree")[1]) == {"deleted": 1}
    assert post(store, "/api/read", thread_id="t", checkpoint_id="a")[0] == 404


def test_import_and_page(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    row = lambda i, parent: json.dumps({"thread_id": "t", "checkpoint_id": i, "checkpoint_no": 0, "parent_checkpoint_id": parent, "messages": [i]})
    status, answer = api.route(s, "POST", "/api/import", row("a", None) + "\n\n" + row("b", "a") + "\n" + row("c", "no") + "\n")
    assert status == 200 and json.loads(answer) == {"checkpoint_count": 2, "message_value_count": 2, "stopped_at": 4, "error": "parent checkpoint not found", "failures": 0}
    status, page = api.route(s, "GET", "/")
    assert status == 200 and "<td>checkpoint_count</td><td>2</td>" in page and api.route(s, "GET", "/no")[0] == 404
    assert json.loads(api.route(s, "GET", "/api/export")[1]) == [{"messages": ["a"]}, {"messages": ["a", "b"]}]
    assert (s.counters["http_requests"], s.counters["http_errors"], s.counters["imported_checkpoints"]) == (4, 1, 2)


def test_commands(store):
    def run(*args, stdin=""):
        out = io.StringIO()
        return api.command(store, list(args), io.StringIO(stdin), out), out.getvalue()

    assert run("put", "u", "r", "0", stdin='["x", 2.5]')[0] == 0
    assert run("put", "u", "s", "1", "r", stdin='[{"k": null}]')[0] == 0
    assert run("get", "u", "s") == (0, '{"messages":["x",2.5,{"k":null}]}\n')
    assert run("get", "u", "q")[0] == 1
    assert json.loads(run("verify")[1]) == {"checked": 2, "failures": 0}
    assert len(run("list")[1].splitlines()) == 2


def test_identity(store):
    first = store.store_id()
    assert store.store_id() == first != store.reidentify()
    assert store.store_id() != first
