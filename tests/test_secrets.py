"""secret_scan against plain Python: all forms of the reference, in its order."""

import hashlib
import re

from tidewright.functions import cleanup
from tidewright.plans.catalogue import QUERIES

NAMES = """google_oauth_access google_oauth_refresh api_key_sk api_key_pk api_key_generic bearer_token github_token github_classic hf_token
password_value secret_value token_value aws_access_key aws_secret_key base64_long auth_header cookie_header set_cookie_header""".split()
BODIES = ["aws " + "aB3/" * 9 + "aB3x end", "blob " + "Zm9v" * 15 + "== end", "ghp_" + "a1" * 18, "ghs_" + "b2" * 20, "Set-Cookie: a=b; Secure\nnext", "Cookie: a=b", "提交" + "a1b2" * 10 + "。", "sha " + "0f" * 20, "plain", None]


def test_secret_scan_reports_and_redacts_every_form(spark, tmp_path):
    assert [name for name, _ in cleanup.SECRETS] == NAMES
    rows = [(6 * k + 2, b) for k, b in enumerate(BODIES)]  # row_id % 6 == 2 plants a line without a secret
    spark.createDataFrame(rows, "row_id bigint, body string").write.parquet(str(tmp_path / "releases.parquet"))
    got = {r.row_id: (r.found, r.digest) for r in QUERIES["secret_scan"](spark, str(tmp_path)).collect()}
    for key, body in rows:
        text = (body or "") + "\nnothing here"
        hits = ",".join(name for name, pattern in cleanup.SECRETS if re.search(pattern, text))
        for _, pattern in cleanup.SECRETS:
            text = re.sub(pattern, "[REDACTED]", text)
        assert got[key] == (hits, hashlib.md5(text.encode()).hexdigest()), body
    assert got[2][0] == "aws_secret_key" and got[8][0] == "base64_long" and "github_classic" in got[14][0]
