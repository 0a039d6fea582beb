"""linkloom: web-capture ETL and link-frontier upkeep as Spark DataFrame jobs.

The usual entry points:

* ``linkloom.registry``            sources, hosts, seeds, handlers (what to crawl, how to read it)
* ``linkloom.plans.capture``       captured responses -> statuses, records, links
* ``linkloom.operators.frontier``  the link table: insert, take, claim, update, delete, count
* ``linkloom.plans.crawl``         frontier expansion, round by round
* ``linkloom.streaming``           the same upkeep as Structured Streaming jobs
"""

import sys

from pyspark import cloudpickle

from linkloom.registry import Handler, Registry, Source

__all__ = ["Handler", "Registry", "Source"]

# Executors need not have this package: the small functions of the pandas extractors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
