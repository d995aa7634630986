"""Settings of a deployment, read from the environment."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from finweave.sources.lake import lake_path, setting

#: Shuffle partitions and whether tables are compacted, by environment; an unknown environment is run as dev, with a warning.
ENVIRONMENTS = {"dev": (8, False), "staging": (200, True), "prod": (2000, True)}


@dataclass(frozen=True)
class Deployment:
    """Where an environment keeps its layers and how its sessions are sized."""

    environment: str
    account: str
    container: str
    jdbc_url: str
    shuffle_partitions: int
    clustered: bool

    def layer(self, name: str) -> str:
        return lake_path(self.container, self.account, f"{name}/")


@dataclass(frozen=True)
class Cluster:
    """Where jobs are sent, and with what token."""

    host: str
    token: str


def cluster(variables: Mapping[str, str] | None = None) -> Cluster:
    """The cluster that the environment names in CLUSTER_HOST and CLUSTER_TOKEN; what is missing is named in one error."""
    have = os.environ if variables is None else variables
    if missing := [name for name in ("CLUSTER_HOST", "CLUSTER_TOKEN") if not have.get(name)]:
        raise ValueError(f"not set: {', '.join(missing)}")
    return Cluster(have["CLUSTER_HOST"], have["CLUSTER_TOKEN"])


def deployment(environment: str = "dev", variables: Mapping[str, str] | None = None) -> Deployment:
    """The deployment of an environment. Account and container must be set; without a JDBC URL no history is written."""
    if environment not in ENVIRONMENTS:
        warnings.warn(f"unknown environment {environment!r}, run as dev", stacklevel=2)
    partitions, clustered = ENVIRONMENTS.get(environment, ENVIRONMENTS["dev"])
    return Deployment(environment, setting("STORAGE_ACCOUNT", variables), setting("STORAGE_CONTAINER", variables), (os.environ if variables is None else variables).get("HISTORY_JDBC_URL", ""), partitions, clustered)
