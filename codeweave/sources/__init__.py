"""Readers of source trees and change sources."""
