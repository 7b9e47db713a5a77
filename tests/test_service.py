import pytest

from reelspark.operators.search import SearchRequest
from reelspark.service import Refused, Service
from reelspark.sources import listing
from reelspark.sources.seed import Settings
from reelspark.sources.store import Store


@pytest.fixture
def service(spark, tmp_path):
    clock = {"now": "2024-01-01 00:00:00"}
    out = Service(spark, Store(spark, f"file://{tmp_path}/store", buckets=2), Settings(admin_emails="a@x.org"), lambda: clock["now"])
    out.clock = clock
    return out


def test_a_catalogue_from_scan_to_page(spark, service):
    folder = {"mimeType": listing.FOLDER, "trashed": False}
    items = [
        {"id": "f1", "name": "Talks", "listed_folder_id": "root", **folder}, {"id": "f2", "name": "2020", "listed_folder_id": "f1", **folder},
        {"id": "v1", "name": "Prayer John 3:16.mp4", "listed_folder_id": "f2", "size": "2048", "modifiedTime": "t1", "scan_seq": 1, "mimeType": "x"},
        {"id": "v2", "name": "Grace.mov", "listed_folder_id": "f1", "size": "4096", "modifiedTime": "t1", "scan_seq": 2, "mimeType": "x"},
        {"id": "v3", "name": "lost.mov", "listed_folder_id": "elsewhere", "size": "1", "scan_seq": 3, "mimeType": "x"},
        {"id": "v4", "name": "bad.mov", "listed_folder_id": "f1", "size": "x", "scan_seq": 4, "mimeType": "x"},
    ]
    service.store.write("items", spark.createDataFrame(items, listing.ITEM))
    assert service.scan() == {"found": 3, "indexed": 2, "skipped": 0, "errors": 1, "folders": 3}
    assert service.scan() == {"found": 3, "indexed": 0, "skipped": 2, "errors": 1, "folders": 3}
    assert service.scan(full=True)["indexed"] == 2
    page = service.videos(SearchRequest(query="prayer", full_text=True))
    assert (page["total"], page["pages"], page["items"][0]["file_id"], page["items"][0]["size_text"], page["items"][0]["folder_path"]) == (1, 1, "v1", "2.0 KB", "/Talks/2020")
    with pytest.raises(Refused):
        service.videos(SearchRequest(sort_by="1; drop"))
    with pytest.raises(Refused):
        service.videos(SearchRequest(query="it's", full_text=True))
    got = service.edit_metadata("v1", {"editorial_title": " My title ", "speaker": "A; B", "file_name": "no"})
    assert (got["editorial_title"], got["file_name"], got["is_new"]) == ("My title", "Prayer John 3:16.mp4", False)
    assert {(t["category"], t["term"]) for t in got["terms"]} >= {("person", "A"), ("person", "B"), ("theme", "Prayer")}
    assert service.videos(SearchRequest(query="my title", full_text=True))["total"] == 1
    assert [t["term"] for t in service.edit_metadata("v1", {"speaker": "C"})["terms"] if t["category"] == "person"] == ["C"]
    service.scan(full=True)
    assert service.video("v1")["editorial_title"] == "My title"
    with pytest.raises(Refused, match="source"):
        service.edit_workflow("v2", "cut", "treated", "v9")
    got = service.edit_workflow("v2", " cut", "", "v1", " note ")
    assert (got["asset_type"], got["workflow_stage"], got["source_file_id"], got["workflow_notes"], got["related"][0]["file_id"]) == ("cut", "digitized", "v1", "note", "v1")
    got = service.set_labels("v1", [" One ", "two", "ONE"], "me@x.org")
    assert (got["labels"], got["last_edit_by"], len(got["edits"])) == (["One", "two"], "me@x.org", 1)
    got = service.set_labels("v1", ["two"], "me@x.org")
    assert (got["labels"], len(got["edits"])) == (["two"], 2) and [x["name"] for x in service.filters()["labels"]] == ["two"]
    assert service.workflow_stats()["assets"] == {"raw": 1, "cut": 1} and service.health()["total_videos"] == 2
    assert [r["file_id"] for r in service.raw_videos()] == ["v1"]
    assert [r["folder_id"] for r in service.search_folders("alk")] == ["f1"]
    with pytest.raises(Refused, match="not a folder"):
        service.set_drive_folder("v1", "me@x.org")
    assert service.set_drive_folder("https://drive.google.com/drive/folders/f1?x", "me@x.org")["configured"] == "f1"
    assert service.start_scan()
    service.job.join(120)
    assert service.scan_state()["status"] == "succeeded" and service.scan_state()["skipped"] == 2
    assert service.delete_files("v1") == 1 and service.video("v2")["source_file_id"] == ""
    with pytest.raises(Refused, match="no such file"):
        service.video("v1")


def test_accounts(service):
    code = service.register(" A@x.org", "long enough")
    with pytest.raises(Refused, match="exists"):
        service.register("a@X.org", "long enough")
    with pytest.raises(Refused, match="unverified"):
        service.login("a@x.org", "long enough")
    with pytest.raises(Refused, match="too soon"):
        service.send_code("a@x.org", again=True)
    with pytest.raises(Refused, match="wrong code"):
        service.verify("a@x.org", "000000" if code != "000000" else "000001")
    service.verify("a@x.org", code)
    with pytest.raises(Refused, match="refused"):
        service.login("a@x.org", "long enougH")
    token = service.login("a@x.org", "long enough")
    assert service.me(token) | {"id": 0} == {"id": 0, "email": "a@x.org", "may_read": True, "may_write": True, "may_admin": True}
    service.clock["now"] = "2024-02-01 00:00:00"
    with pytest.raises(Refused, match="no session"):
        service.me(token)
    token = service.login("a@x.org", "long enough")
    service.logout(token)
    with pytest.raises(Refused, match="no session"):
        service.me(token)


def test_a_read_only_catalogue(spark, tmp_path):
    s = Service(spark, Store(spark, f"file://{tmp_path}/s", buckets=2))
    s.seed()
    assert s.workflow_stats()["links"] == {"linked_cuts": 3, "unlinked_cuts": 0}
    assert s.workflow_stats()["tracking"]["missing_labels"] == 3
    closed = Service(spark, s.store, Settings(read_only=True))
    with pytest.raises(Refused, match="read-only"):
        closed.set_labels("demo-0", [], "x")
    assert closed.videos(SearchRequest())["total"] == 6
