"""Inboxes that are written, read and removed one after another hold all emails, and leave no files."""

import glob
import os

import pytest

from shipcheck.plans import bridge

import test_oracles


@pytest.mark.parametrize("name", ["a11_folder_of_files", "a3_inbox_format"])
def test_inboxes_one_after_another(spark, monkeypatch, name):
    monkeypatch.setattr(bridge, "AT_ONCE", 600)
    monkeypatch.setattr(bridge, "MAILS", 20)
    seen, written = [], bridge._written

    def watched(emails, attachments, root, files, n):
        seen.append(root)
        assert not [r for r in seen[:-1] if os.path.exists(r)]  # those before are gone
        out = written(emails, attachments, root, files, n)
        assert len(glob.glob(f"{root}/inbox/*.json")) > 16
        return out

    monkeypatch.setattr(bridge, "_written", watched)
    test_oracles.test_query_equals_sql(spark, name)
    assert len(seen) == 3 and not any(map(os.path.exists, seen))
