"""Recipes: steps whose suggestions are applied or listed by confidence."""
