"""End-to-end plans and the registered queries with their oracle SQL."""

from factweave.plans.general import general
from factweave.plans.knowledge import knowledge
from factweave.plans.reading import reading

REGISTRIES = [general, knowledge, reading]
