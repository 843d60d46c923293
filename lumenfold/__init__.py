"""Vision-language instruction data on Spark: conversion, episodes, mixing, prompts, scoring."""

__version__ = "0.1.0"
