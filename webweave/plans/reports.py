"""Report objects over the stored tables: clusters and the link network."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame

from webweave.operators import graph, reports
from webweave.session import materialize


class ClusterReport:
    """Clusters with their domains and backlinks; a new threshold gives a new report."""

    def __init__(
        self,
        clusters: DataFrame,
        scraped: DataFrame,
        matches: DataFrame,
        backlinks: DataFrame,
        domains: DataFrame,
        threshold: datetime | str | None = None,
        mode: str = "min",
        strict: bool = False,
    ) -> None:
        self._tables = (clusters, scraped, matches, backlinks, domains)
        self._options = {"mode": mode, "strict": strict}
        members = reports.cluster_domains(clusters, scraped, domains, strict)
        links = reports.cluster_backlinks(clusters, matches, backlinks, strict)
        since = threshold if threshold is not None else reports.new_threshold(members, mode)
        self.cluster_domains = reports.flag_new(members, since)
        self.cluster_backlinks = reports.flag_new(links, since)

    def with_threshold(self, threshold: datetime | str | None) -> ClusterReport:
        return ClusterReport(*self._tables, threshold=threshold, **self._options)

    @cached_property
    def cluster_info(self) -> DataFrame:
        return reports.in_report_order(reports.cluster_info(self.cluster_domains))

    def get_cluster_domains(self, cluster: str) -> DataFrame:
        return reports.get_cluster(self.cluster_domains, cluster)

    def get_cluster_backlinks(self, cluster: str) -> DataFrame:
        return reports.get_cluster(self.cluster_backlinks, cluster)

    def get_cluster_domains_by_domain(self, domain: str) -> DataFrame:
        return reports.cluster_of_domain(self.cluster_domains, domain)

    def get_cluster_backlinks_by_url(self, url: str) -> DataFrame:
        return reports.cluster_of_url(self.cluster_backlinks, url)


class NetworkReport:
    """The link network of one link type, with node removal; every change gives a new report."""

    def __init__(
        self,
        domains: DataFrame,
        scraped: DataFrame,
        link_type: str = "all_known_domains",
        before: NetworkReport | None = None,
        removed: str | None = None,
    ) -> None:
        """``before`` and ``removed``: the report of the same tables that a domain is taken out of."""
        self._tables = (domains, scraped)
        self.link_type = link_type
        self.network_domains = graph.network_domains(domains, scraped)
        if before is None:
            self.removed_nodes: tuple[str, ...] = ()
            self._whole = self
            self.edges = materialize(graph.build_edges(self.network_domains, link_type))
            self._members = graph.members(graph.edge_nodes(self.edges), self.edges)
        else:
            self.removed_nodes = (*before.removed_nodes, removed)
            self._whole = before._whole
            names = domains.sparkSession.createDataFrame([(removed,)], "domain string")
            self._members, self.edges = graph.members_without(before._members, before.edges, names)
        self.nodes = self._members.select("domain")

    @cached_property
    def domain_info(self) -> DataFrame:
        return materialize(graph.members_info(self._members, self.network_domains))

    @cached_property
    def component_info(self) -> DataFrame:
        return graph.component_info(self.domain_info).orderBy("component")

    def remove_node(self, node: str) -> NetworkReport:
        return NetworkReport(*self._tables, self.link_type, self, node)

    def reset_network_graph(self) -> NetworkReport:
        return self._whole

    def set_link_type(self, link_type: str) -> NetworkReport:
        return NetworkReport(*self._tables, link_type)

    def get_component(self, number: int) -> DataFrame:
        return graph.component(self.domain_info, number)

    def get_component_by_domain(self, domain: str) -> DataFrame:
        return graph.component_of(self.domain_info, [domain])

    def component_subgraph(self, number: int) -> tuple[DataFrame, DataFrame]:
        return graph.component_subgraph(self.domain_info, self.edges, number)
