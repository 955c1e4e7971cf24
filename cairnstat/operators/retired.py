"""Names of operators that are gone; calling one says so."""

from __future__ import annotations

RETIRED = (
    "trendVar", "decomposeVar", "testVar", "improvedCV2", "technicalCV2", "makeTechTrend", "multiBlockVar", "multiBlockNorm", "overlapExprs",
    "parallelPCA", "bootstrapCluster", "clusterModularity", "clusterPurity", "clusterKNNGraph", "clusterSNNGraph", "coassignProb",
    "createClusterMST", "connectClusterMST", "orderClusterMST", "quickPseudotime", "testPseudotime", "doubletCells", "doubletCluster",
    "doubletRecovery", "combinePValues", "convertTo",
)


def __getattr__(name: str):
    if name in RETIRED:
        def gone(*args, **kwargs):
            raise NotImplementedError(f"{name} has been retired and has no replacement here")

        return gone
    raise AttributeError(name)
