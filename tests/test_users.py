import hashlib
from datetime import datetime

from conftest import rows
from mascate.operators import users

OLD, NOW = datetime(2025, 1, 1), datetime(2026, 6, 1, 12)
CHANGES = ("seq BIGINT, op STRING, user_id INT, login STRING, password STRING, email STRING, active INT, "
           "person_id INT, seller_no INT, type INT, store STRING, created_by INT, changed_by INT")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def table(make):
    return make("users", [
        dict(user_id=n, login=f"U{n}", password_md5=md5("old"), email=f"u{n}@x", active=n % 2, created=OLD, type=1)
        for n in range(1, 6)
    ])


def changes(spark, *items):
    names = [part.split()[0] for part in CHANGES.split(", ")]
    return spark.createDataFrame([tuple({"seq": i, **item}.get(n) for n in names) for i, item in enumerate(items)], CHANGES)


def test_directory_and_lookup(make, spark):
    table_ = table(make)
    listed = users.user_directory(table_)
    assert [r.user_id for r in listed.collect()] == [1, 3, 5] and "password_md5" not in listed.columns
    asked = spark.createDataFrame([(2,), (2,), (9,)], "user_id INT")
    found = users.user_lookup(table_, asked)
    assert rows(found, "user_id") == [(2,)] and "password_md5" not in found.columns
    assert rows(users.unknown_users(table_, asked)) == [(9,)]


def test_apply_changes(make, spark):
    result = users.apply_user_changes(table(make), changes(
        spark,
        dict(op="update", user_id=1, login="  new.one ", password=" pw\n", changed_by=7),
        dict(op="update", user_id=1, email="a@x"),
        dict(op="update", user_id=1, email="b@x", active=0),
        dict(op="update", user_id=99, email="z@x"),
        dict(op="update", user_id=2, login="u3"),
        dict(op="update", user_id=3, login=" u3 ", email="same@x"),
        dict(op="create", user_id=10, login="ten", password="p", created_by=4, seller_no=8),
        dict(op="create", user_id=10, login="other", password="p"),
        dict(op="create", user_id=4, login="four", password="p"),
        dict(op="create", user_id=11, login="New.One", password="p"),
        dict(op="update", user_id=5, login="ten"),
    ), NOW)
    assert rows(result.rejected, "seq", "user_id", "reason") == sorted([
        (3, 99, "unknown_user"), (4, 2, "login_taken"), (7, 10, "user_exists"), (8, 4, "user_exists"),
        (9, 11, "login_taken"), (10, 5, "login_taken"),
    ], key=repr)
    after = {r.user_id: r for r in result.users.collect()}
    assert sorted(after) == [1, 2, 3, 4, 5, 10] and result.users.columns == table(make).columns
    one, ten = after[1], after[10]
    assert (one.login, one.password_md5, one.email, one.active) == ("NEW.ONE", md5("pw"), "b@x", 0)
    assert (one.created, one.changed, one.changed_by, one.type) == (OLD, NOW, 7, 1)
    assert (ten.login, ten.email, ten.active, ten.created, ten.changed) == ("TEN", "0", 1, NOW, None)
    assert (ten.created_by, ten.seller_no, ten.password_md5) == (4, 8, md5("p"))
    assert after[3].email == "same@x" and after[3].login == "U3"
    untouched = {r.user_id: r for r in table(make).collect()}
    assert all(after[n] == untouched[n] for n in (2, 4, 5))
    assert len({r.login for r in after.values()}) == len(after)


def test_soft_delete(make, spark):
    asked = spark.createDataFrame([(1,), (1,), (9,)], "user_id INT")
    after = users.soft_delete_users(table(make), asked, NOW)
    assert rows(after, "user_id", "active", "changed") == sorted(
        [(1, 0, NOW), (2, 0, None), (3, 1, None), (4, 0, None), (5, 1, None)], key=repr)


def test_refused_creates_leave_the_user_free(make, spark):
    result = users.apply_user_changes(table(make), changes(
        spark,
        dict(op="create", user_id=900, login="u1", password="p"),
        dict(op="create", user_id=900, login="b", password="p"),
        dict(op="create", user_id=901, login="B", password="p"),
        dict(op="create", user_id=902, login=None, password="p"),
        dict(op="create", user_id=902, login="c", password=None),
        dict(op="create", user_id=902, login="c", password="p"),
        dict(op="create", user_id=903, login="c", password="p"),
        dict(op="create", user_id=903, login="d", password="p"),
        dict(op="create", user_id=904, login="d", password="p"),
        dict(op="update", user_id=1, login="e"),
    ), NOW)
    assert rows(result.rejected, "seq", "reason") == sorted([
        (0, "login_taken"), (2, "login_taken"), (3, "login_and_password_required"),
        (4, "login_and_password_required"), (6, "login_taken"), (8, "login_taken"),
    ], key=repr)
    after = {r.user_id: r.login for r in result.shown().collect()}
    assert (after[900], after[902], after[903], after[1]) == ("B", "C", "D", "E") and len(after) == 8
    assert "password_md5" not in result.shown().columns
