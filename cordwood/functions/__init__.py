"""cordwood.functions"""
