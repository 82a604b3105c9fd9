"""The builder of binary documents, for tests."""

from quire.plans.build import *  # noqa: F403
