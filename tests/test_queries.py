"""Every registered query against its SQL, and the driver contract."""

import pytest
from oracle import TABLES, assert_same

import __spark_entry__
from maskworks.functions import secrets
from maskworks.plans import registered


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(registered.QUERIES[name](spark, sf), registered.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registered.QUERIES[name](spark, sf).count() >= 0


def test_driver_contract(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Something that each detector finds; nothing here opens anything.
SAMPLES = {
    "AWS_ACCESS_KEY": "AKIA" + "Q7" * 8, "AWS_SECRET_KEY": 'my_aws_secret_key = "' + "Ab1/" * 10 + '"', "GOOGLE_API_KEY": "AIza" + "x-Y_7" * 7, "GOOGLE_OAUTH_SECRET": "GOCSPX-" + "aB3_" * 7,
    "GOOGLE_OAUTH_TOKEN": "ya29." + "aB3-" * 6, "AZURE_STORAGE_KEY": "AccountKey=" + "a/" * 43 + "==", "AZURE_SAS": "?sig=" + "aB%2" * 11 + "%3D", "STRIPE_KEY": "sk_live_" + "aB3d" * 5,
    "STRIPE_WEBHOOK": "whsec_" + "aB3d" * 7, "GITHUB_TOKEN": "ghp_" + "aB3d" * 9, "GITHUB_PAT": "github_pat_" + "aB3_" * 16, "GITLAB_TOKEN": "glpat-" + "aB3-" * 6, "SLACK_TOKEN": "xoxb-" + "12-a" * 4,
    "SLACK_WEBHOOK": "https://hooks.slack.com/services/" + "T0/B" * 6, "MODEL_PROVIDER_KEY": "sk-proj-" + "aB3_" * 6, "SECRET_KEY": "sk-" + "aB3d" * 9, "NPM_TOKEN": "npm_" + "aB3d" * 9,
    "PYPI_TOKEN": "pypi-" + "aB3_" * 11, "SENDGRID_KEY": "SG." + "aB3_" * 5 + "." + "c-D4" * 5, "TWILIO_KEY": "SK" + "0a" * 16, "MAILGUN_KEY": "key-" + "0a" * 16, "DIGITALOCEAN_TOKEN": "dop_v1_" + "0a" * 32,
    "SHOPIFY_TOKEN": "shpat_" + "0A" * 16, "HUGGINGFACE_TOKEN": "hf_" + "aB3d" * 9, "TELEGRAM_TOKEN": "123456789:AA" + "x_-" * 11, "JWT": "eyJ" + "aB3_" * 3 + ".eyJ" + "aB3_" * 3 + "." + "aB3-" * 3,
    "BEARER_TOKEN": "Bearer\t" + "aB3~" * 6 + "==", "BASIC_AUTH": "Authorization: Basic dXNlcjpwYXNz", "PRIVATE_KEY": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    "CONNECTION_PASSWORD": "postgres://user:pa55:word@host/db", "ASSIGNED_SECRET": "client_secret_v2 = '" + "aB3-" * 6 + "'", "POSSIBLE_CREDENTIAL": 'passwd: "open-sesame"', "EMAIL": "first.last+tag@mail.example.co.uk",
    "PRIVATE_IP": "172.20.3.44",
}


def test_secret_findings_of_all_types_equal_their_sql(spark, sf, tmp_path):
    for table in TABLES:
        if table != "documents":
            (tmp_path / f"{table}.parquet").symlink_to(f"{sf}/{table}.parquet")
    shapes = ("{0}", "x{0}", "{0}Z9", "_{0}_", "({0})-", "{0} {0}\n{1}", "{0},{1},{0}", "say {0}. And", "'{0}'", '"{0}"', "1{0}.5", "é{0}é", "a/{0}/b", "{0}@{1}")
    some = list(SAMPLES.values())
    texts = [shape.format(s, some[i - 1]) for i, s in enumerate(some) for shape in shapes] + ["", None, "token = 'short'", 'secret = "' + "a" * 30 + '"', "10.1.2.3.4 10.300.1.1 192.168.1.1.", "a@b.c a@b.cc_ a@b.cc9"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    found = registered.secret_findings(spark, str(tmp_path))
    assert {r["type"] for r in found.collect()} == set(SAMPLES) == {d.type for d in secrets.DETECTORS}
    assert_same(found, registered.ORACLE_SQL["secret_findings"], str(tmp_path))
