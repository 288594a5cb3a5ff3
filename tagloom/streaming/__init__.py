"""Operators kept current on a stream; each has a batch twin it must agree with."""

from tagloom.streaming.jobs import *  # noqa: F401,F403
