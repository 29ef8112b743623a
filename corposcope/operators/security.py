"""Access rules: sensitive files, path validation, workspace roots."""
from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corposcope.errors import AccessDenied
from corposcope.functions.text import filename

#: (how, pattern, reason); the first match gives the reason. Fixed values.
SENSITIVE = (
    ("exact", ".env", "environment variables"), ("prefix", ".env.", "environment variables"),
    ("suffix", ".env", "environment variables"), ("exact", ".envrc", "direnv config"),
    ("exact", "credentials.json", "credentials file"), ("exact", "credentials.yaml", "credentials file"),
    ("exact", "credentials.yml", "credentials file"), ("exact", "secrets.json", "secrets file"),
    ("exact", "secrets.yaml", "secrets file"), ("exact", "secrets.yml", "secrets file"), ("contains", ".secret.", "secrets file"),
    ("suffix", ".pem", "private key/certificate"), ("suffix", ".key", "private key"), ("suffix", ".p12", "PKCS#12 keystore"),
    ("suffix", ".pfx", "PKCS#12 keystore"), ("suffix", ".jks", "Java keystore"), ("suffix", ".keystore", "keystore"),
    ("suffix", ".truststore", "truststore"), ("exact", "id_rsa", "SSH private key"), ("prefix", "id_rsa.", "SSH private key"),
    ("exact", "id_ed25519", "SSH private key"), ("prefix", "id_ed25519.", "SSH private key"),
    ("exact", "id_ecdsa", "SSH private key"), ("prefix", "id_ecdsa.", "SSH private key"),
    ("exact", "id_dsa", "SSH private key"), ("prefix", "id_dsa.", "SSH private key"), ("suffix", ".kdbx", "KeePass database"),
    ("path", ".aws/credentials", "AWS credentials"), ("path", ".aws/config", "AWS config"),
    ("path", ".azure/credentials", "Azure credentials"), ("exact", "gcloud-credentials.json", "GCloud credentials"),
    ("prefix", "service-account", "service account key"), ("exact", "application_default_credentials.json", "GCloud ADC"),
    ("path", ".digitalocean/config.yaml", "DigitalOcean config"), ("exact", "terraform.tfstate", "Terraform state"),
    ("prefix", "terraform.tfstate.", "Terraform state backup"), ("suffix", ".tfstate", "Terraform state"),
    ("suffix", ".tfvars", "Terraform variables (may contain secrets)"), ("exact", "kubeconfig", "Kubernetes config"),
    ("suffix", ".kubeconfig", "Kubernetes config"), ("path", ".kube/config", "Kubernetes config"),
    ("exact", ".vault-token", "Vault token"), ("exact", ".npmrc", "npm config (may contain tokens)"),
    ("exact", ".yarnrc", "yarn config"), ("exact", ".yarnrc.yml", "yarn config"), ("exact", ".pypirc", "PyPI credentials"),
    ("exact", "pip.conf", "pip config"), ("path", ".gem/credentials", "RubyGems credentials"),
    ("path", ".bundle/config", "Bundler config"), ("path", ".docker/config.json", "Docker credentials"),
    ("path", ".nuget/NuGet.Config", "NuGet config"), ("exact", ".git-credentials", "Git credentials"),
    ("exact", ".netrc", "network credentials"), ("exact", "_netrc", "network credentials (Windows)"),
    ("exact", "master.key", "Rails master key"), ("suffix", ".master.key", "master key"),
    ("exact", "encryption.key", "encryption key"), ("exact", "signing.key", "signing key"), ("exact", ".htpasswd", "htpasswd file"),
    ("suffix", ".htpasswd", "htpasswd file"), ("exact", "shadow", "shadow password file"), ("path", ".ssh/config", "SSH config"),
    ("exact", "authorized_keys", "SSH authorized keys"), ("path", ".idea/dataSources.xml", "JetBrains DB connections"),
    ("path", ".idea/webServers.xml", "JetBrains server creds"), ("exact", ".bash_history", "shell history"),
    ("exact", ".zsh_history", "shell history"), ("exact", ".psql_history", "psql history"),
    ("exact", ".mysql_history", "mysql history"), ("exact", ".node_repl_history", "Node REPL history"),
)
#: Directories that are no workspaces. Fixed values.
BLOCKED_ROOTS = ("/", "/etc", "/var", "/usr", "/bin", "/sbin", "/sys", "/proc", "/dev", "/boot", "/tmp", "/lib", "/lib64", "/opt",
                 "/usr/bin", "/usr/sbin", "/usr/lib", "/usr/lib64", "/usr/local", "/private/etc", "/private/var", "/private/tmp")
BLOCKED_HOME = (".ssh", ".aws", ".gnupg", ".gpg", ".config", ".local/share")


def sensitive_reason(path: Column) -> Column:
    """Reason why a file must not be shown, or null; case matters."""
    name = filename(path)
    out = F.lit(None).cast("string")
    for how, pattern, reason in reversed(SENSITIVE):
        p = F.lit(pattern)
        hit = {"exact": name == p, "prefix": F.startswith(name, p), "suffix": F.endswith(name, p),
               "contains": F.contains(name, p), "path": F.contains(path, p)}[how]
        out = F.when(hit, reason).otherwise(out)
    return out


def sensitive_pattern() -> str:
    """All rules as one regular expression on the path, for filters that need no reason."""
    form = {"exact": "(?:^|/){}$", "prefix": "(?:^|/){}[^/]*$", "suffix": "{}$", "contains": "{}[^/]*$", "path": "{}"}
    return "|".join(form[how].format(re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", pattern)) for how, pattern, _ in SENSITIVE)


def visible(df, path: str = "path"):
    """Rows of files that may be shown; filtered before any limit."""
    return df.where(~F.col(path).rlike(sensitive_pattern()))


def path_verdict(path: Column) -> Column:
    """'ok', 'nul', 'absolute' or 'outside' for a requested relative path (set form)."""
    parts = F.split(F.regexp_replace(path, "//+", "/"), "/")
    down = lambda acc, p: F.struct((acc["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
                                   F.least(acc["m"], acc["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("m"))
    low = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), down)["m"]
    return (F.when(path.isNull() | F.contains(path, F.lit("\u0000")), "nul")
             .when(F.startswith(path, F.lit("/")), "absolute").when(low < 0, "outside").otherwise("ok"))


def validated(root: str, path: str) -> str:
    """Absolute path of a relative path below the root; raises AccessDenied."""
    if "\0" in path:
        raise AccessDenied("path holds a NUL byte")
    if path.startswith("/"):
        raise AccessDenied("absolute paths are not allowed")
    whole = posixpath.normpath(posixpath.join(root, path))
    real_root, real = os.path.realpath(root), os.path.realpath(whole)
    if not (real == real_root or real.startswith(real_root.rstrip("/") + "/")):
        raise AccessDenied("path leaves the workspace")
    return whole


def readable(root: str, path: str) -> str:
    whole = validated(root, path)
    name = posixpath.basename(whole)
    test = {"exact": lambda p: name == p, "prefix": name.startswith, "suffix": name.endswith, "contains": lambda p: p in name, "path": lambda p: p in whole}
    for how, pattern, reason in SENSITIVE:
        if test[how](pattern):
            raise AccessDenied(f"sensitive file: {reason}")
    return whole


def workspace_root(path: str) -> str:
    """Canonical workspace directory; raises AccessDenied for system, home and private directories."""
    if path in BLOCKED_ROOTS:
        raise AccessDenied("system directory")
    real = os.path.realpath(path)
    if not os.path.isdir(real):
        raise AccessDenied("not a directory")
    home = os.path.realpath(os.path.expanduser("~"))
    if real in BLOCKED_ROOTS or real == home:
        raise AccessDenied("system or home directory")
    for d in BLOCKED_HOME:
        private = os.path.realpath(os.path.join(home, d))
        if real == private or real.startswith(private + "/"):
            raise AccessDenied("directory with private user data")
    if len([p for p in real.split("/") if p]) < 2:
        raise AccessDenied("directory is too broad")
    return real
